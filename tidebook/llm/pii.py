"""Personal data: labelers vote on spans, their reliabilities are estimated without labels, a classifier decides."""
from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidebook.llm.shared import hold, logistic, sigmoid, small_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "national_id", "iban", "hidden_email", "name")
KINDS = BASE + ADDED
LABELERS = ("pattern", "check", "gazetteer", "context", "surroundings")
KEEP = 0.5

#: Gazetteers.
NAMES = frozenset("""James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph
Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Sandra Paul Ashley Steven Emily Andrew Donna Peter
Michelle Anna Laura Julia Maria Hans Klaus Heike Jürgen Sabine Wolfgang Ursula Pierre Marie Jean Sophie Luc Camille Carlos Carmen
José Lucía Javier Pilar Antonio Isabel""".split())
TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra".split())
MAIL_ENDINGS = frozenset("com org net edu gov io de fr es uk eu info co".split())
ASKING = re.compile(r"(?i:phone|call|tel|mobile|fax|contact|mail|reach|ssn|social|iban|account|card|visa|credit|name|ip|host|address|anruf|konto|correo|numéro|número)")
AGAINST = re.compile(r"(?i:order|invoice|version|isbn|total|sku|serial|build|ticket|page|sample|example|dummy|test)")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WIDER = {
    "local_phone": re.compile(r"(?<![\w+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])"),
    "national_id": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)"),
    "hidden_email": re.compile(r"(?<![\w.])[A-Za-z0-9._-]{2,40}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,40}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,20}){1,3}"),
    "name": re.compile(r"(?<!\w)([A-ZÀ-Þ][a-zß-ÿ]+)\.? [A-ZÀ-Þ][a-zß-ÿ]+(?: [A-ZÀ-Þ][a-zß-ÿ]+)?(?!\w)"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """An address has one @ only, so each @ is looked at once: the run of local characters before it and a domain after."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the four fixed kinds; a match that fails its check is dropped and not tried again."""
    out = [(0, a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Base spans and wider ones of the added kinds that touch none of them or of an earlier kind."""
    out = base_spans(text)
    taken = sorted((a, b) for _, a, b in out)
    digits = bool(_DIGIT.search(text))
    for kind, name in enumerate(ADDED, len(BASE)):
        if name == "hidden_email" and "at" not in text or not digits and name in ("local_phone", "national_id", "iban"):
            continue
        found = []
        for m in _WIDER[name].finditer(text):
            if name == "name" and m.group(1) not in NAMES and m.group(1) not in TITLES:
                continue
            i = bisect.bisect_left(taken, (m.end(), -1))
            if i == 0 or max(b for _, b in taken[max(0, i - 4):i]) <= m.start():
                found.append((kind, *m.span()))
        out += found
        taken = sorted(taken + [(a, b) for _, a, b in found])
    return sorted(out)


def votes(text: str, kind: int, a: int, b: int) -> tuple[int, ...]:
    """One vote a labeler: 1 personal data, -1 not, 0 no opinion."""
    span, name = text[a:b], KINDS[kind]
    digits = "".join(c for c in span if c in "0123456789")
    pattern = 1 if kind < len(BASE) or name in ("national_id", "iban") else 0
    if digits and len(set(digits)) == 1:
        check = -1
    elif name == "card":
        check = 1
    elif name == "iban":
        flat = span.replace(" ", "")
        check = 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    elif name == "national_id":
        check = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif name in ("local_phone", "phone"):
        check = 1 if digits[-10:-9] not in ("0", "1") and len(digits) >= 10 else 0
    elif name == "ip":
        check = -1 if digits.startswith("0") or span.startswith("127.") else 0
    else:
        check = 0
    gazetteer = 0
    if name in ("email", "hidden_email"):
        gazetteer = 1 if re.split(r"\W+", span)[-1].lower() in MAIL_ENDINGS else 0
    elif name == "name":
        words = re.split(r"\W+", span)
        gazetteer = 1 if words[0] in NAMES or len(words) > 1 and words[1] in NAMES else 0
    before = text[max(0, a - 40):a]
    if name == "name" and span.split(" ")[0].rstrip(".") in TITLES:
        context = 1
    else:
        context = 1 if ASKING.search(before) else -1 if AGAINST.search(before) else 0
    touching = (a > 0 and (text[a - 1].isalnum() or text[a - 1] in "-_/")) or (b < len(text) and (text[b].isalnum() or text[b] in "_/"))
    return pattern, check, gazetteer, context, -1 if touching else 0


def code(kind: int, vote: tuple[int, ...], length: int) -> int:
    """Kind, votes and a class of length as one number; there are at most KINDS * 3**LABELERS * 4 of them."""
    n = kind
    for v in vote:
        n = n * 3 + v + 1
    return n * 4 + (length > 8) + (length > 14) + (length > 22)


def decode(n: int) -> tuple[int, tuple[int, ...], int]:
    n, size = divmod(n, 4)
    vote = []
    for _ in LABELERS:
        n, v = divmod(n, 3)
        vote.append(v - 1)
    return n, tuple(reversed(vote)), size


def spans_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` of (text, ...) with the candidate spans of the whole text and the code of each."""
    out = T.StructType([docs.schema[c] for c in keep]).add("spans", T.ArrayType(
        T.StructType().add("kind", "integer").add("a", "integer").add("b", "integer").add("code", "integer")))
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "a": a, "b": b, "code": code(k, votes(t, k, a, b), b - a)} for k, a, b in candidates(t)]
                     for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(found, arrow.field("spans").type)], schema=arrow)

    return docs.select(*keep, "text").mapInArrow(run, out)


@dataclass
class Model:
    """Reliabilities of the labelers, and the probability of every code that can occur."""
    right: np.ndarray      # share of right votes by labeler
    probability: dict[int, float]


def estimate(counts: dict[int, int], rounds: int = 50) -> Model:
    """Expectation-maximisation over counts of codes: each labeler has one reliability and, by class, a share of votes it
    casts; each kind has its share of true spans. The posteriors then train a logistic classifier on votes,
    kind and length, which also judges codes that were never seen."""
    if not counts:
        counts = {}
    codes = sorted(counts)
    parts = [decode(c) for c in codes]
    kind = np.array([k for k, _, _ in parts], dtype=int)
    v = np.array([x for _, x, _ in parts], dtype=int).reshape(-1, len(LABELERS))
    n = np.array([counts[c] for c in codes], dtype=float)
    right = np.full(len(LABELERS), 0.8)
    share = np.full(len(KINDS), 0.5)
    p = 1 / (1 + np.exp(-1.5 * v.sum(axis=1))) if len(codes) else np.empty(0)
    for _ in range(rounds if len(codes) else 0):
        agree = ((v == 1) * p[:, None] + (v == -1) * (1 - p[:, None])) * n[:, None]
        cast = (v != 0) * n[:, None]
        right = np.clip((agree.sum(axis=0) + 8) / (cast.sum(axis=0) + 10), 0.55, 0.98)
        true = np.bincount(kind, weights=n * p, minlength=len(KINDS))
        share = np.clip((true + 2) / (np.bincount(kind, weights=n, minlength=len(KINDS)) + 4), 0.05, 0.95)
        odds = np.log(share / (1 - share))[kind] + (v * np.log(right / (1 - right))).sum(axis=1)
        p = sigmoid(odds)
    every = [(k, x, s) for k in range(len(KINDS)) for x in itertools.product((-1, 0, 1), repeat=len(LABELERS)) for s in range(4)]

    def columns(rows):
        out = np.zeros((len(rows), len(KINDS) + 2 * len(LABELERS) + 4))
        for i, (k, x, s) in enumerate(rows):
            out[i, k] = 1
            for j, value in enumerate(x):
                if value:
                    out[i, len(KINDS) + 2 * j + (value > 0)] = 1
            out[i, -4 + s] = 1
        return out

    if not len(codes):
        total = [float(sigmoid(sum(x) * 1.5)) for _, x, _ in every]
    else:
        x = columns(parts)
        w = logistic(np.concatenate([x, x]), np.concatenate([np.ones(len(x)), np.zeros(len(x))]), 1e-4,
                     np.concatenate([n * p, n * (1 - p)]) / n.sum() * 1000)
        total = sigmoid(columns(every) @ w[:-1] + w[-1])
    return Model(right, {code(k, x, (0, 9, 15, 23)[s]): float(q) for (k, x, s), q in zip(every, total)})


def train(spans: DataFrame) -> Model:
    """Counts every code over all documents; what reaches the driver is bounded by the number of codes."""
    rows = spans.select(F.explode("spans.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    return estimate({r["code"]: r["n"] for r in rows})


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Model]:
    """(doc_id, spans) per row of `docs`, spans ordered by kind and start with their probability; and the model.

    The four base kinds stay whatever the vote. A span of another kind stays if the classifier gives it KEEP or more.
    Offsets are code points, ends exclusive. Null is an empty text; texts without candidates have no spans. Each row is
    judged by itself, so repeated rows are alike. An empty table gives no rows and a model that trusts the majority.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = hold(spans_of(source, ["doc_id"]))
    model = train(found)
    return found.withColumn("spans", _decided(F.col("spans"), model)), model


def _decided(spans, model: Model):
    sure = [c for c, p in model.probability.items() if p >= KEEP and decode(c)[0] >= len(BASE)]
    table = F.array(*[F.lit(c) for c in sorted(sure)]) if sure else F.array().cast("array<int>")
    return F.filter(spans, lambda s: (s["kind"] < len(BASE)) | F.array_contains(table, s["code"]))


def redacted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns of `docs`; in `text`, personal data are replaced by their kind in brackets, as in [EMAIL]."""
    small_batches(docs.sparkSession)
    sure = frozenset(c for c, p in model.probability.items() if p >= KEEP)
    out = T.StructType([T.StructField(f"_c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    at = docs.columns.index(text)
    out.fields[at].dataType = T.StringType()
    out = T.StructType(out.fields)
    arrow = to_arrow_schema(out)

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        found, end, parts = [], 0, []
        for k, a, b in candidates(t):
            if k < len(BASE) or code(k, votes(t, k, a, b), b - a) in sure:
                found.append((a, -b, k))
        for a, b, k in sorted(found):
            if a >= end:
                parts += [t[end:a], f"[{KINDS[k].upper()}]"]
            end = max(end, -b)
        return "".join([*parts, t[end:]]) if parts else t

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    source = docs.select(*[F.col(f"`{c}`").cast("string" if c == text else f.dataType).alias(f"_c{i}") for i, (c, f) in enumerate(zip(docs.columns, docs.schema.fields))])
    return source.mapInArrow(run, out).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def digest(spans: list[tuple[str, int, int]]) -> str:
    """Hash of spans as kind:start:end, comma-joined."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
