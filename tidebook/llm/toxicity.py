"""Toxicity of text restored by a noisy-channel decoder."""
from __future__ import annotations

import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.shared import NOT_SPACE, U64, hold, labelled, logistic_rows, mixed, pieces, sigmoid, signed, small_batches

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
FEATURES = 20_000    # word starts and words that carry weight, at most
STARTS = (4, 5, 6)   # bytes of the word starts that are features, besides whole words
LETTERS = 50_000     # trigrams of the character model, at most: the most frequent; rarer ones fall back to pairs and letters
#: A feature must occur in so many toxic training documents, and so many times as often as in clean ones.
LEAST, TIMES = 3, 8.0

#: Signs that stand for letters.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
         "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
_SIGN = "".join(re.escape(c) for c in SIGNS)
_LETTER = r"[^\W\d_]"
_UNIT = rf"(?:{_LETTER}|[{_SIGN}])"
_ALONE, _ENDS, _GAP = r"(?<![^\W_])", r"(?![^\W_])", r"[ .\-_*]{1,2}"
#: Signs before the first letter of a span, at most: a table of numbers is not looked through from each of its numbers.
LEADING = 24
#: Letters and signs that stand apart, two or more of them with a letter; words with a sign at any place; a letter three times running.
#: A run of letters is tried from its start only and no run is tried twice, so the time grows with the text.
SUSPECT = re.compile(
    rf"{_ALONE}(?:[{_SIGN}]{_GAP}){{0,{LEADING}}}+{_LETTER}(?:{_GAP}{_UNIT})+{_ENDS}"
    rf"|{_ALONE}[{_SIGN}]{_GAP}(?:[{_SIGN}]{_GAP}){{0,{LEADING}}}+{_LETTER}{_ENDS}"
    rf"|[{_SIGN}]{{1,{LEADING}}}+{_LETTER}{_UNIT}*+"
    rf"|(?<!{_LETTER}){_LETTER}++[{_SIGN}]{_UNIT}*+"
    rf"|(?<!{_LETTER}){_LETTER}*({_LETTER})\1\1+{_LETTER}*")
#: The check before it, which finds a part of whatever SUSPECT finds.
_HINT = re.compile(rf"[{_SIGN}]{_LETTER}|{_LETTER}[{_SIGN}]|({_LETTER})\1\1|{_ALONE}{_UNIT}{_GAP}{_UNIT}{_ENDS}")
SETTLE = 64  # after so many letters of a span, what all paths agree on is settled


class CharModel:
    """Trigram model over the letters of words, interpolated with lower orders."""

    def __init__(self, counts: dict[str, int]) -> None:
        tri, bi, uni = Counter(), Counter(), Counter()
        for gram, n in counts.items():
            tri[gram] += n
            bi[gram[:2]] += n
            uni[gram[2]] += n
        two = Counter()
        for gram, n in tri.items():
            two[gram[1:]] += n
        total, kinds = sum(uni.values()) or 1, len(uni) + 1
        self._one = {c: np.log(0.1 * (n + 1) / (total + kinds)) for c, n in uni.items()}
        self._floor = float(np.log(0.1 / (total + kinds)))
        first = Counter()
        for pair, n in two.items():
            first[pair[0]] += n
        lower = {p: 0.9 * n / first[p[0]] + 0.1 * (uni[p[1]] + 1) / (total + kinds) for p, n in two.items()}
        self._two = {p: float(np.log(0.3 * v)) for p, v in lower.items()}
        self._three = {g: float(np.log(0.7 * n / bi[g[:2]] + 0.3 * lower[g[1:]])) for g, n in tri.items()}

    def log(self, context: str, c: str) -> float:
        found = self._three.get(context + c)
        if found is None:
            found = self._two.get(context[1:] + c)
            if found is None:
                found = self._one.get(c, self._floor)
        return found


_NOISE = {"sign": -2.0, "gap": -1.0, "repeat": -0.7, "same": -0.05, "digit": -3.0}


def _letters(c: str, model: CharModel) -> list[tuple[str, float]]:
    """What may stand behind one written character, with the channel's log probability; "" is nothing."""
    if c in " .-_*":
        return [("", _NOISE["gap"])]
    if c in SIGNS:
        return [(x, _NOISE["sign"]) for x in SIGNS[c]] + [("", _NOISE["sign"] - 4)]
    return [(c, _NOISE["same"])]


def _boundary(c: str) -> float | None:
    """The channel's log probability of a character that ends a word and is written as it is meant; None for letters."""
    if c in " .-_*" or c in "!|+(":
        return _NOISE["same"]
    return _NOISE["digit"] if c in SIGNS else None


def restored(span: str, model: CharModel) -> str:
    """Viterbi path through the lattice of letters of a span: signs become letters, gaps vanish, both may also
    stay and end a word, and a letter written again and again is kept once or twice, as the character model likes it best.

    The paths are carried on over a span of any length; what they agree on is settled from time to time, so each holds
    the last letters only."""
    span, done, before = span.lower(), [], ""
    best = {"^^": (0.0, "")}
    for i, c in enumerate(span):
        again, stays = c == before, _boundary(c)
        before = c
        if stays is None and not again and len(best) == 1:  # one path and one way on
            (context, (score, text)), = best.items()
            best = {context[1] + c: (score + _NOISE["same"] + model.log(context, c), text + c)}
        else:
            best = _step(best, c, stays, again, model)
        if i % SETTLE == SETTLE - 1:
            agreed = os.path.commonprefix([t for _, t in best.values()])
            done.append(agreed)
            best = {k: (s, t[len(agreed):]) for k, (s, t) in best.items()}
    done.append(max((s + (model.log(k, "$") if k != "^^" else 0.0), t) for k, (s, t) in best.items())[1])
    return "".join(done)


def _step(best: dict, c: str, stays: float | None, again: bool, model: CharModel) -> dict:
    """All paths one written character on."""
    ways, to = _letters(c, model), {}
    if stays is not None:
        to["^^"] = max((s + stays + (model.log(k, "$") if k != "^^" else 0.0), t + c) for k, (s, t) in best.items())
    if again and c not in SIGNS:
        ways = [*ways, ("", _NOISE["repeat"])]
    for context, (score, text) in best.items():
        for letter, cost in ways:
            if letter:
                state, value = context[1] + letter, score + cost + model.log(context, letter)
            else:
                state, value = context, score + cost
            if state not in to or value > to[state][0]:
                to[state] = (value, text + letter)
    return to


class Restorer:
    """Decodes the suspect spans of a text; remembers what spans became."""

    def __init__(self, model: CharModel) -> None:
        self._model, self._seen = model, {}

    def _one(self, m: re.Match) -> str:
        span = m.group(0)
        if span not in self._seen:
            if len(self._seen) > 50_000:
                self._seen.clear()
            self._seen[span] = restored(span, self._model)
        return self._seen[span]

    def __call__(self, text: str) -> str:
        return SUSPECT.sub(self._one, text) if _HINT.search(text) else text


def letter_counts(texts: DataFrame) -> CharModel:
    """Trigram counts of the words of (text), summed over tasks; the LETTERS most frequent of those that occur twice are kept."""
    out = T.StructType().add("g", "string").add("n", "long")
    arrow, letters = to_arrow_schema(out), re.compile(rf"{_LETTER}+")

    def run(batches):
        words: Counter = Counter()

        def sent():
            counts: Counter = Counter()
            for w, n in words.items():
                w = f"^^{w}$"
                for i in range(len(w) - 2):
                    counts[w[i:i + 3]] += n
            words.clear()
            return pa.RecordBatch.from_pydict({"g": list(counts), "n": list(counts.values())}, schema=arrow)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words.update(letters.findall(text.lower()))
                if len(words) > 200_000:
                    yield sent()
        yield sent()

    rows = texts.select("text").mapInArrow(run, out).groupBy("g").agg(F.sum("n").alias("n"))
    return CharModel({r["g"]: r["n"] for r in rows.where("n > 1").orderBy(F.desc("n"), "g").limit(LETTERS).collect()})


def _features(batch: pa.RecordBatch, restore: Restorer):
    """(rows, document, feature hash) of the words and word starts of the restored texts, each once a document."""
    texts = pa.array([restore(t) if t else "" for t in batch.column("text").to_pylist()], pa.large_string())
    for part, words in pieces(pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["i", "text"]), "text", NOT_SPACE):
        start, end = _trimmed(words)
        found = [(words.doc, words.hashed(start, end))]
        for n in STARTS:
            at = np.flatnonzero(end - start > n)
            found.append((words.doc[at], words.hashed(start[at], start[at] + n)))
        yield part.column("i").to_numpy(), np.concatenate([d for d, _ in found]), np.concatenate([h for _, h in found])


def _trimmed(words) -> tuple[np.ndarray, np.ndarray]:
    """Words without the ASCII signs at their ends."""
    letter = np.zeros(256, dtype=bool)
    letter[0x61:0x7B] = letter[0x80:] = letter[0x30:0x3A] = True
    good = letter[words.buf]
    n = len(good)
    after = np.where(good, np.arange(n), n)
    after = np.minimum.accumulate(after[::-1])[::-1]
    before = np.maximum.accumulate(np.where(good, np.arange(n), -1))
    start = np.minimum(after[words.start], words.end) if n else words.start
    end = np.maximum(before[words.end - 1] + 1, start) if n else words.end
    return start, np.maximum(end, start)


class Model:
    """Weights of features, and how a document's sums of them become a probability."""

    def __init__(self, letters: CharModel, hashes: np.ndarray, weights: np.ndarray, curve: np.ndarray) -> None:
        self.letters, self.hashes, self.weights, self.curve = letters, hashes, weights, curve
        self.small = np.zeros(1 << 18, dtype=bool)
        self.small[(hashes >> U64(46)).astype(np.int64)] = True

    def sums(self, batch: pa.RecordBatch, restore: Restorer) -> np.ndarray:
        """For each document: the strongest weight, and the log of how much weight there is."""
        out = np.zeros((batch.num_rows, 2))
        for rows, doc, h in _features(batch, restore):
            near = np.flatnonzero(self.small[(h >> U64(46)).astype(np.int64)])
            if not len(near) or not len(self.hashes):
                continue
            at = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[near]
            pairs = np.unique(np.column_stack([doc[near][hit], at[hit]]), axis=0)
            strongest, total = np.zeros(len(rows)), np.zeros(len(rows))
            np.maximum.at(strongest, pairs[:, 0], self.weights[pairs[:, 1]])
            np.add.at(total, pairs[:, 0], self.weights[pairs[:, 1]])
            out[rows] = np.column_stack([strongest, np.log1p(total)])
        return out

    def scores(self, sums: np.ndarray) -> np.ndarray:
        return sigmoid(sums @ self.curve[:-1] + self.curve[-1])


def train(docs: DataFrame, labels: DataFrame, parts: int = FOLDS, kept_out: int = HELD_OUT) -> Model:
    """Fits the character model, the features' weights and the curve on all labelled documents outside the fold.

    Features are picked on three quarters of them, the curve is fitted on the rest, so that it does not trust features
    more than new texts will bear out. Only the model and sums over the documents reach the driver.
    """
    small_batches(docs.sparkSession)
    sample = labelled(docs, labels, "toxic", parts, kept_out)
    sample = sample.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(4)))
    letters = letter_counts(sample)
    out = T.StructType().add("h", "long").add("y", "integer").add("n", "long")
    arrow = to_arrow_schema(out)

    def count(batches):
        restore = Restorer(letters)
        for batch in batches:
            y = batch.column("y").to_numpy()
            for rows, doc, h in _features(batch, restore):
                for label in (0, 1):
                    of = y[rows][doc] == label
                    _, once = np.unique(h[of] ^ mixed(doc[of].astype(U64)), return_index=True)
                    values, n = np.unique(h[of][once], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(values)), pa.array(np.full(len(n), label, dtype=np.int32)), pa.array(n)], schema=arrow)

    sizes = {(r["y"], r["p"]): r["count"] for r in sample.groupBy("y", (F.col("part") > 0).alias("p")).count().collect()}
    n1, n0 = sizes.get((1, True), 0), sizes.get((0, True), 0)
    base = np.log((n1 + sizes.get((1, False), 0) + 0.5) / (n0 + sizes.get((0, False), 0) + 9.5))
    if not n1 or not n0:
        return Model(letters, np.empty(0, dtype=U64), np.empty(0), np.array([0.0, 0.0, base]))
    found = (sample.where("part > 0").select("text", "y").mapInArrow(count, out).groupBy("h")
             .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"),
                  F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
             .where((F.col("a") >= LEAST) & (F.col("a") / n1 >= TIMES * (F.col("b") + 0.5) / n0))
             .withColumn("w", F.log(((F.col("a") + 0.1) / n1) / ((F.col("b") + 0.5) / n0)) * F.least(F.col("a") / F.lit(10.0), F.lit(1.0)))
             .orderBy(F.desc(F.col("w") * F.sqrt("a")), "h").limit(FEATURES).select("h", "w").toArrow())
    hashes = found.column("h").to_numpy().view(np.int64).astype(np.int64).view(U64)
    order = np.argsort(hashes)
    model = Model(letters, hashes[order], found.column("w").to_numpy()[order], np.zeros(3))
    kept = T.StructType().add("y", "integer").add("a", "double").add("b", "double")
    kept_arrow = to_arrow_schema(kept)

    def measure(batches):
        restore = Restorer(letters)
        for batch in batches:
            x = model.sums(batch, restore)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x[:, 0]), pa.array(x[:, 1])], schema=kept_arrow)

    rest = hold(sample.where("part = 0").select("text", F.col("y").cast("int").alias("y")).mapInArrow(measure, kept))
    if rest.select("y").distinct().count() < 2:
        model.curve = np.array([0.0, 0.0, base])
    else:
        model.curve = logistic_rows(rest, lambda x: x)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", restored_text: bool = False) -> DataFrame:
    """All rows and columns of `docs` with score (0 to 1) and, if wanted, restored_text.

    Every whole text is restored and scored; null is empty. An empty text gets the score of a text without any
    feature. Rows are judged one by one, so repeated rows score alike.
    """
    small_batches(docs.sparkSession)
    names = {"score", "restored_text"} if restored_text else {"score"}
    kept = [c for c in docs.columns if c.lower() not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    out = T.StructType([docs.schema[c] for c in kept]).add("score", "double")
    if restored_text:
        out = out.add("restored_text", "string")
    arrow = to_arrow_schema(out)

    def run(batches):
        restore = Restorer(model.letters)
        for batch in batches:
            one = pa.RecordBatch.from_arrays([batch.column(batch.num_columns - 1)], names=["text"])
            more = [pa.array(model.scores(model.sums(one, restore)))]
            if restored_text:
                more.append(pa.array([restore(t) for t in one.column("text").to_pylist()], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], schema=arrow)

    return source.mapInArrow(run, out)
