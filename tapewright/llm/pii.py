"""Personal data: exact rules, and boosted trees over generous candidates for what the rules miss."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions.durable import checkpoint
from tapewright.llm import pii_rules as rules
from tapewright.llm.boosting import BoostedTrees
from tapewright.llm.common import documents

#: Forms of candidates that the driver fits on at most; where there are more, the features that count are halved until there are not.
MAX_FORMS = 200_000

#: Weight of each kind in the fit, however many candidates it has.
KIND_WEIGHT = 4_000.0

#: Share of held-out candidates above a kind's threshold that must be right, and how many there must be.
PRECISION, LEAST_ABOVE = 0.99, 8

#: Where in a form (label, features) the features are that count.
_FIRST = 1 + len(rules.CANDIDATES)
COUNTED = [*range(_FIRST, _FIRST + len(rules.CAPS)), _FIRST + len(rules.CAPS) + 4]


def _form(text: str, candidate: tuple[int, int, int], sure: list[tuple[int, int, int]]) -> bytes:
    return bytes([rules.weakly_right(text, *candidate, sure)]) + rules.features(text, *candidate)


def proposals(docs: DataFrame, *keep: str) -> DataFrame:
    """(id, mark, held, keep ..., sure, some, forms) of every document: the spans of the exact rules, all candidates, both as flat (start, rank, stop), and
    of each candidate its weak label (`pii_rules.weakly_right`) and features, one byte each. The documents of one half of the ids are held out."""

    def rows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sures, somes, forms = [], [], []
            for text in b["text"]:
                sure, some = rules.base_spans(text), rules.candidates(text)
                sures.append([n for span in sure for n in span])
                somes.append([n for span in some for n in span])
                forms.append([_form(text, c, sure) for c in some])
            yield b[["id", "mark", "held", *keep]].assign(sure=sures, some=somes, forms=forms)

    d = documents(docs).withColumn("held", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(2)) == 0)
    kept = "".join(f"{c} {dict(d.dtypes)[c]}, " for c in keep)
    return d.mapInPandas(rows, f"id {dict(docs.dtypes)['doc_id']}, mark long, held boolean, {kept}sure array<long>, some array<long>, forms array<binary>")


def _coarse(forms: Iterable[bytes], halvings: int) -> np.ndarray:
    """One row of bytes a form, with the features that count halved so often."""
    x = np.frombuffer(b"".join(forms), np.uint8).reshape(-1, 1 + rules.FEATURES).copy()
    x[:, COUNTED] >>= halvings
    return x


def counted_forms(found: DataFrame, halvings: int = 0) -> DataFrame:
    """(held, form, n) over the candidates of all documents; `halvings` of the features that count make fewer forms."""

    def coarse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(form=[v.tobytes() for v in _coarse(b["form"], halvings)])

    forms = found.select("held", F.explode("forms").alias("form")).groupBy("held", "form").agg(F.count(F.lit(1)).alias("n"))
    return forms if not halvings else forms.mapInPandas(coarse, "held boolean, form binary, n long").groupBy("held", "form").agg(F.sum("n").alias("n"))


def made_forms(halvings: int = 0) -> pd.DataFrame:
    """(held, form, n) of the invented texts of `pii_rules.made_texts`."""
    rows = []
    for i, text in enumerate(rules.made_texts()):
        sure = rules.base_spans(text)
        rows += [(i % 2 == 0, _form(text, c, sure), 1) for c in rules.candidates(text)]
    return pd.DataFrame(rows, columns=["held", "form", "n"]).assign(form=[v.tobytes() for v in _coarse([r[1] for r in rows], halvings)])


def train(found: DataFrame, most: int = MAX_FORMS):
    """(model, {rank: threshold}, halvings) from the candidates of all documents and of the invented texts, half of either held out.

    Candidates of one form are counted by Spark, and forms are small whole numbers, so what the driver fits on is bounded. Every kind has the same
    weight in the fit. A kind has a threshold where enough held-out candidates above it are right.
    """
    halvings = 0
    while (forms := checkpoint(counted_forms(found, halvings))).count() > most and halvings < 6:
        halvings += 1
    rows = sorted((bool(h), bytes(f), int(n)) for part in (forms.toPandas(), made_forms(halvings)) for h, f, n in part.itertuples(index=False))
    table = _coarse([f for _, f, _ in rows], 0).astype(float)
    right, x = table[:, 0], table[:, 1:]
    held, n = np.array([h for h, _, _ in rows]), np.array([n for _, _, n in rows], float)
    rank = x[:, : len(rules.CANDIDATES)].argmax(1)

    def weights(of: np.ndarray) -> np.ndarray:
        return n[of] * (KIND_WEIGHT / np.maximum(np.bincount(rank[of], n[of], len(rules.CANDIDATES)), 1.0))[rank[of]]

    model = BoostedTrees().fit(x[~held], right[~held], weights(~held)).calibrate(x[held], right[held], weights(held))
    thresholds = {}
    p = model.probability(x)
    for r in sorted(set(rank[held])):
        own = held & (rank == r)
        value, of = np.unique(-p[own], return_inverse=True)
        above, good = np.cumsum(np.bincount(of, n[own])), np.cumsum(np.bincount(of, n[own] * right[own]))
        fine = np.nonzero((good >= PRECISION * above) & (above >= LEAST_ABOVE))[0]
        if len(fine):
            thresholds[int(r)] = float(max(-value[fine[-1]], 0.5))
    return model, thresholds, halvings


def _found(docs: DataFrame, *keep: str) -> DataFrame:
    """(id, mark, keep ..., base, spans) as in `find`."""
    found = checkpoint(proposals(docs, *keep))
    model, thresholds, halvings = train(found)
    kind = "array<struct<kind:string,start:long,stop:long>>"

    def spans(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = rules.KINDS + rules.MORE_KINDS
        triples = lambda flat: list(zip(*[iter(map(int, flat))] * 3, strict=True))
        for b in batches:
            forms = [f for fs in b["forms"] for f in fs]
            p = iter(model.probability(_coarse(forms, halvings)[:, 1:].astype(float)) if forms else ())
            bases, alls = [], []
            for sure, some in zip(map(triples, b["sure"]), map(triples, b["some"]), strict=True):
                every = list(sure)
                scored = [(-next(p), i, c) for i, c in enumerate(some)]
                for q, _, (a, r, z) in sorted(scored):
                    if r in thresholds and -q >= thresholds[r] and not any(a < y and x < z for x, _, y in every):
                        every.append((a, r, z))
                bases.append([(names[r], a, z) for a, r, z in sure])
                alls.append([(names[r], a, z) for a, r, z in sorted(every)])
            yield b[["id", "mark", *keep]].assign(base=bases, spans=alls)

    types = dict(found.dtypes)
    return found.select("id", "mark", *keep, "sure", "some", "forms").mapInPandas(spans, ", ".join(f"{c} {types[c]}" for c in ("id", "mark", *keep)) + f", base {kind}, spans {kind}")


def find(docs: DataFrame) -> DataFrame:
    """(id, mark, text, base, spans): spans as arrays of (kind, start, stop) in order; stop is exclusive.

    `base` are the spans of the exact rules, `spans` those and the model's: candidates above the threshold of
    their kind, best first, that overlap none taken before. Null or empty text has none. Repeated rows get the same spans.
    """
    return _found(docs, "text")


def _names(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document; the counts are of base spans."""
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return _found(docs).select(F.col("id").alias("doc_id"), *map(n, ("email", "ip", "card", "phone")), F.sha2(_names("base"), 256).alias("base_sha256"), _names("spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts with every span replaced by its kind in brackets."""
    cuts = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["stop"]))
    piece = lambda s, i: F.concat(F.substring("text", (F.get(cuts, i) + 1).cast("int"), (s["start"] - F.get(cuts, i)).cast("int")), F.lit("["), s["kind"], F.lit("]"))
    last = F.element_at(cuts, -1)
    tail = F.substring("text", (last + 1).cast("int"), F.length("text"))
    return find(docs).select(F.col("id").alias("doc_id"), F.concat(F.array_join(F.transform("spans", piece), ""), tail).alias("text"))
