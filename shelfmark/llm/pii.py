"""Personal data by weak supervision.

Base spans come from fixed patterns and checks. Looser candidates (phone numbers without
a plus sign, addresses written out with "at" and "dot", identity numbers, secret tokens) are
voted on by three labelers: the pattern's own check (1 for base spans, which are true; 0 for looser ones
that fail it, else none), a gazetteer (top-level names, dialling prefixes) and the words
before (0 without a cue). Expectation-maximisation over the counts of the looser vote
patterns estimates each labeler's reliability by kind of candidate; the posteriors train a
logistic span classifier by kind on votes and shape (the separators used). Candidates it accepts, clear of base
spans, are added; base spans always stay. Vote and shape patterns are few by construction,
so their counts over the whole corpus fit the driver at any size.

Defined cases: a null text is empty; texts of any length are scanned once; null doc_ids and
repeated rows stay; no candidates or no documents leave the classifier rejecting all; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .tables import read
from .words import slices

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOTTED = re.compile(r"[0-9][0-9.]*")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser candidates by kind.
LOOSE = {
    "email": re.compile(r"\b[a-z0-9._-]{2,64} ?[\[(]?\bat\b[\])]? ?[a-z0-9-]{2,63} ?[\[(]?\bdot\b[\])]? ?[a-z]{2,8}\b", re.I),
    "phone": re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    "id": re.compile(r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,128}={0,2}(?![A-Za-z0-9+/_@-])"),
}
#: What a text with such a candidate has in any case, faster to look for.
HINTS = {
    "email": lambda text: "dot" in text.lower(),
    "phone": re.compile(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}").search,
    "id": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}").search,
    "secret": re.compile(r"[A-Za-z0-9+/_-]{20}").search,
}
SEPARATORS = "()[].- "
#: How issued tokens begin; what many are written in.
ISSUED, HEX = re.compile(r"(sk|pk|ghp|gho|xox[abp]|glpat|AKIA|ASIA|eyJ)[A-Za-z0-9_-]"), re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: A vote pattern: kind, votes, shape.
PATTERN = re.compile(r"([a-z]+)([012]{3})(.*)")
#: Rates before any evidence, P(vote 1 | truth) by truth, and their weight in shares of a kind's candidates; that of the even prior.
RATE, RATE_WEIGHT, PRIOR_WEIGHT = (0.2, 0.8), 0.5, 2.0
#: The same where a labeler is known to differ, by kind and labeler: eight of ten numbers pass as dialling prefixes by chance, and checksums look like tokens.
RATES = {("phone", 1): (0.8, 0.95), ("secret", 1): (0.7, 0.9)}
ENDINGS = frozenset("com org net edu gov io info de fr es eu uk".split())
CUES = {
    "email": re.compile(r"(mail|contact|write|address|correo|adresse)\W*(\w+\W+){0,3}$", re.I),
    "phone": re.compile(r"(phone|tel|call|mobile|fax|telefon|appel)\w*\W*(\w+\W+){0,3}$", re.I),
    "secret": re.compile(r"(token|secret|passw|api.?key|access.?key|private.?key|credential|auth|bearer)\w*\W*(\w+\W+){0,2}$", re.I),
    "id": re.compile(r"(ssn|social|identity|security|tax)\w*\W*(\w+\W+){0,3}$", re.I),
    "ip": re.compile(r"(ip|host|server|address)\W*(\w+\W+){0,3}$", re.I),
    "card": re.compile(r"(card|visa|credit|karte|carte|tarjeta)\w*\W*(\w+\W+){0,3}$", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    for run in DOTTED.finditer(text):
        if run.group().count(".") >= 3:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text, run.start(), run.end()) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def votes(kind: str, strict: bool, text: str, start: int, end: int) -> tuple[int, int, int]:
    """Of the pattern's check, the gazetteer and the context: 1 for, 0 against, 2 none."""
    own = text[start:end]
    digits = re.sub(r"[^0-9]", "", own)
    check = True
    if kind == "email":
        check = bool(re.search(r"[\[(]", own))
        gazetteer = 1 if re.split(r"[^a-z]+", own.lower().rstrip("]) "))[-1] in ENDINGS else 0
    elif kind == "phone":
        check = digits[-7:-6] not in ("0", "1")
        gazetteer = 1 if digits[-10:-7][:1] not in ("0", "1") and len(digits) >= 10 else 0
    elif kind == "id":
        check = digits[:1] != "9"
        gazetteer = 0 if digits[:3] in ("000", "666") or digits[3:5] == "00" or digits[5:] == "0000" else 2
    elif kind == "secret":
        check = len(set(own)) >= 8
        gazetteer = 1 if ISSUED.match(own) or (len(own) in (32, 40, 48, 64) and HEX.fullmatch(own)) else 0 if own.count("/") > 2 or own.count("-") > 4 else 2
    else:
        gazetteer = 2
    context = int(bool(CUES[kind].search(text, max(0, start - 40), start)))
    return 1 if strict else 2 if check else 0, gazetteer, context


def pattern(kind: str, strict: bool, text: str, start: int, end: int) -> str:
    """Kind, votes and shape: which of SEPARATORS stand in the span."""
    own = text[start:end]
    return kind + "".join(map(str, votes(kind, strict, text, start, end))) + "".join(c for c in SEPARATORS if c in own)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<struct<kind:string,start:int,end:int>>, more array<struct<kind:string,start:int,end:int,votes:string>>, seen array<string>"


def _find(batches):
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    more_type = pa.struct([*span, ("votes", pa.string())])
    for batch in slices(batches):
        base, more, seen = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            own = base_spans(text)
            loose, votes_seen = [], []
            for kind, start, end in own:
                votes_seen.append(pattern(kind, True, text, start, end))
            begins = [s for _, s, _ in sorted(own, key=lambda x: x[1])]
            reach = list(accumulate((e for _, _, e in sorted(own, key=lambda x: x[1])), max))
            for kind, loosely in LOOSE.items():
                for m in loosely.finditer(text) if HINTS[kind](text) else ():
                    # spans that begin before its end; do they reach its start?
                    k = bisect_left(begins, m.end())
                    if not k or reach[k - 1] <= m.start():
                        v = pattern(kind, False, text, *m.span())
                        loose.append({"kind": kind, "start": m.start(), "end": m.end(), "votes": v})
                        votes_seen.append(v)
            base.append([dict(zip(("kind", "start", "end"), s)) for s in own])
            more.append(loose)
            seen.append(votes_seen)
        counts = [pa.array([sum(s["kind"] == k for s in b) for b in base], pa.int64()) for k in KINDS]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *counts, pa.array(base, pa.list_(span)), pa.array(more, pa.list_(more_type)), pa.array(seen, pa.list_(pa.string()))], ["doc_id", *[f"n_{k}" for k in KINDS], "base", "more", "seen"])


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 50) -> tuple[dict[str, float], dict[str, np.ndarray]]:
    """Posterior of each vote pattern, and by kind each labeler's P(vote 1 | truth) by truth.

    Dawid-Skene with abstentions (2), over counts of patterns, each kind for itself. Base
    spans (pattern vote 1) are true; they say nothing of looser candidates' rates. Rates lean
    on RATE, that is on labelers better than chance, as one labeler alone would fit any.
    """
    posterior, rates = {p: 1.0 for p, _ in patterns}, {}
    loose = [(p, *PATTERN.fullmatch(p).groups()[:2], c) for p, c in patterns]
    for kind in sorted({k for _, k, _, _ in loose}):
        own = [(p, votes, c) for p, k, votes, c in loose if k == kind and votes[0] != "1"]
        if not own:
            continue
        v = np.array([[int(c) for c in votes] for _, votes, _ in own])
        n = np.array([c for _, _, c in own], float)
        cast = v != 2
        some = RATE_WEIGHT * n.sum()
        q = (np.where(cast, v, 0).sum(1) + 0.5) / (cast.sum(1) + 1.0)
        rate = np.zeros((2, 3))
        for _ in range(rounds):
            prior = (n @ q + PRIOR_WEIGHT * n.sum() / 2) / ((1 + PRIOR_WEIGHT) * n.sum())
            for truth, weight in ((1, n * q), (0, n * (1 - q))):
                rate[truth] = [((weight * (v[:, k] == 1)).sum() + RATES.get((kind, k), RATE)[truth] * some) / ((weight * cast[:, k]).sum() + some) for k in range(3)]
            logit = np.full(len(v), np.log(prior / (1 - prior)))
            for k in range(3):
                logit += np.where(v[:, k] == 1, np.log(rate[1, k] / rate[0, k]), np.where(v[:, k] == 0, np.log((1 - rate[1, k]) / (1 - rate[0, k])), 0))
            q = 1 / (1 + np.exp(-logit))
        rates[kind] = rate
        posterior |= {p: float(x) for (p, _, _), x in zip(own, q)}
    return posterior, rates


def span_classifier(patterns: list[tuple[str, int]]) -> dict[str, float]:
    """Probability of each pattern by a logistic regression by kind, trained on EM posteriors."""
    found, _ = reliabilities(patterns)
    posterior = dict(found)
    for kind in sorted({PATTERN.fullmatch(p)[1] for p, _ in patterns}):
        own = [(*PATTERN.fullmatch(p).groups(), p, c) for p, c in patterns]
        own = [(votes, shape, p, c) for k, votes, shape, p, c in own if k == kind and votes[0] != "1"]
        if not own:
            continue
        x = np.array([[1.0, *[float(votes[j] == c) for j in range(3) for c in "01"], *[float(c in shape) for c in SEPARATORS]] for votes, shape, _, _ in own])
        n = np.array([c for *_, c in own], float)
        y = np.array([posterior[p] for _, _, p, _ in own])
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            curve = (x.T * (n * np.maximum(p * (1 - p), 1e-3))) @ x + 0.1 * np.eye(len(w))
            w -= np.linalg.solve(curve, x.T @ (n * (p - y)) + 0.1 * w)
        found |= dict(zip([p for _, _, p, _ in own], (1 / (1 + np.exp(-x @ w))).tolist()))
    return found


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256, spans and the spans as an array, of every row."""
    found = scratch.write(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, FOUND), "pii")
    patterns = [(r["votes"], r["count"]) for r in found.select(F.explode("seen").alias("votes")).groupBy("votes").count().orderBy("votes").collect()]
    accepted = [p for p, x in span_classifier(patterns).items() if x >= 0.5]
    order = F.array(*[F.lit(k) for k in (*KINDS, "id", "secret")])
    added = F.filter("more", lambda s: s["votes"].isin(accepted) if accepted else F.lit(False))
    every = F.concat("base", F.transform(added, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    ranked = F.array_sort(F.transform(every, lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(ranked).alias("spans"), F.size(added).alias("n_added"), F.size(F.filter(added, lambda s: s["kind"] == "secret")).alias("n_secret"))


def op6_personal_data(spark, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents", "doc_id", "text"))
