"""Trains the boosted trees of pii.py on made-up candidates and writes pii_model.json: python -m plumbline.llm.pii_training

No corpus rows are used. TRAIN_ROWS, CALIBRATION_ROWS and the seed are the documented bounds of the sample. Candidates
stand alone, in lists under one cue, and in records beside other personal data; negatives are numbers of orders, parts
and versions, alone and in lists, plain dates, and what fails its check. Each kind's threshold is the lowest score at
which a held-out fold reaches PRECISION; precision and recall at the thresholds are those of a third fold.
"""

from __future__ import annotations

import json
import random
import re
from pathlib import Path

import numpy as np

from .pii import ALIKE_AFTER, ALIKE_BEFORE, BEFORE, CONTEXT, CUES, EXTRA_KINDS, FEATURES, MASKED_END, NEAR, NEGATIVE_CUES, WITH_DIGITS, mod97

TRAIN_ROWS, CALIBRATION_ROWS, SEED = 9000, 6000, 7
ROUNDS, RATE, PRECISION = 30, 0.4, 0.97
FILLER = "the of and report value table item with from den und les por total sum section figure list".split()
CUE_WORDS = {
    "phone_local": "call|phone:|tel.|mobile|fax|phones", "ssn": "ssn|social security number|ssn:|social", "iban": "iban|account|iban:|accounts",
    "email_masked": "mail|contact|write to|e-mail:", "birth": "born|date of birth:|dob|birthday|born on",
}
OTHER_WORDS = {"phone_local": "part|serial|order|invoice", "ssn": "part|version|order|ref", "iban": "serial|part|sku", "email_masked": "model|ref", "birth": "version|build|order|ticket"}


def features(kind: str, text: str, before: str, after: str) -> list[float]:
    """The same numbers as pii.feature_columns, from plain strings."""
    digits = re.sub("[^0-9]", "", text)
    valid = {
        "phone_local": len(digits) == 10 and digits[0] not in "01" and digits[3] not in "01",
        "ssn": digits[:3] not in ("000", "666") and digits[:1] != "9" and digits[3:5] != "00" and digits[5:] != "0000",
        "iban": mod97(re.sub("[^A-Za-z0-9]", "", text)) == 1,
        "email_masked": bool(re.search(MASKED_END, text)),
        "birth": 1 <= int(digits[4:6] or 0) <= 12 and 1 <= int(digits[6:8] or 0) <= 31 if kind == "birth" else False,
    }[kind]
    before, after = before[-CONTEXT:], after[:CONTEXT]
    plain = re.sub(" +", " ", re.sub(WITH_DIGITS, "", before))
    return [float(x) for x in (
        *(kind == k for k in EXTRA_KINDS), len(text), len(digits), len(set(digits)), len(re.findall("[^A-Za-z0-9]", text)), valid,
        bool(re.search(CUES, plain[-BEFORE:])), bool(re.search(NEGATIVE_CUES, plain[-BEFORE:])), bool(re.search(CUES, plain[-NEAR:])),
        bool(re.search(ALIKE_BEFORE, before)), bool(re.search(ALIKE_AFTER, after)),
    )]


def value_of(rng: random.Random, kind: str, good: bool) -> str:
    """A text of the kind's format; not good ones fail its check."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "phone_local":
        a, b = (rng.choice("23456789") + d(2) for _ in range(2)) if good else (rng.choice("01") + d(2) for _ in range(2))
        return rng.choice([f"({a}) {b}-{d(4)}", f"{a}-{b}-{d(4)}", f"{a}.{b}.{d(4)}", f"{a} {b} {d(4)}"])
    if kind == "ssn":
        return f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}" if good else f"{rng.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}"
    if kind == "iban":
        upper = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
        country, body = rng.choice([("DE", d(18)), ("FR", d(23)), ("ES", d(20)), ("GB", upper(4) + d(14)), ("NL", upper(4) + d(10))])
        check = 98 - mod97(country + "00" + body)
        raw = f"{country}{check if good else (check + rng.randint(1, 95)) % 97:02d}{body}"
        return " ".join(raw[i : i + 4] for i in range(0, len(raw), 4)) if rng.random() < 0.5 else raw
    if kind == "email_masked":
        at, dot = rng.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" [at] ", ".")])
        name = rng.choice(FILLER) + rng.choice(["", "", d(2), "." + rng.choice(FILLER)])
        return f"{name}{at}{rng.choice(FILLER)}{dot}{rng.choice(['com', 'org', 'net', 'de'])}" if good else f"{name}{at.strip()}{rng.choice(FILLER)}.{rng.choice(['value', 'index', 'size', 'next'])}"
    return f"{rng.randint(1920, 2015)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" if good else f"{rng.randint(1920, 2015)}-{rng.randint(13, 19)}-{rng.randint(1, 28):02d}"


def candidate(rng: random.Random) -> tuple[str, str, str, str, int]:
    kind, label = rng.choice(EXTRA_KINDS), rng.random() < 0.5
    filler = lambda k: " ".join(rng.choices(FILLER, k=k))
    joint = rng.choice([" ", ", ", "; ", " . ", " or ", " and ", " | "])
    cue, other = (rng.choice(w[kind].split("|")) for w in (CUE_WORDS, OTHER_WORDS))
    good = label or kind not in ("iban", "email_masked") and rng.random() < 0.7
    text = value_of(rng, kind, good)
    form = rng.random()
    if not label and good and kind != "birth":
        cue = other  # what is sound in form and no personal data says what it is instead
    elif not label:
        cue = rng.choice([other, *FILLER[:6], *([] if good else [cue])])
    elif kind in ("iban", "email_masked", "phone_local") and rng.random() < 0.2:
        cue = rng.choice(FILLER)  # sound forms without a word
    elif rng.random() < 0.1:
        cue = f"{other} {cue}"
    if form < 0.45:  # alone
        before, after = f"{filler(4)} {cue} ", f" {filler(3)}"
    elif form < 0.75:  # a list under one cue, or one where each entry has it
        same = [value_of(rng, kind, good) for _ in range(rng.randint(1, 4))]
        each = rng.random() < 0.5
        entry = f"{joint}{cue} " if each else joint
        before, after = f"{filler(2)} {cue} {entry.join(same)}{entry}", f"{joint}{value_of(rng, kind, good)} {filler(1)}"
    elif label:  # a record
        beside = [value_of(rng, k, True) for k in EXTRA_KINDS if k != kind and rng.random() < 0.6]
        before, after = f"{filler(2)}{joint}{joint.join(beside)}{joint}{cue} ", f"{joint}{value_of(rng, rng.choice(EXTRA_KINDS), True)}"
    else:  # numbers of other things around
        numbers = [str(rng.randint(1, 99999)) for _ in range(rng.randint(1, 3))]
        before, after = f"{filler(1)} {joint.join(numbers)}{joint}{cue} ", f"{joint}{rng.randint(1, 9999)} {filler(2)}"
    return kind, text, before, after, int(label)


def sample(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    rng = random.Random(seed)
    made = [candidate(rng) for _ in range(rows)]
    return np.array([features(*m[:4]) for m in made]), np.array([m[4] for m in made], dtype=float), [m[0] for m in made]


def leaf(gradient: np.ndarray, weight: np.ndarray) -> float:
    return float(gradient.sum() / (weight.sum() + 1.0))


def split(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> tuple[int, float] | None:
    best, found = 1e-6, None
    total = gradient.sum() ** 2 / (weight.sum() + 1)
    for f in range(x.shape[1]):
        for cut in (np.unique(x[:, f])[:-1] + np.unique(x[:, f])[1:]) / 2:
            left = x[:, f] <= cut
            gain = gradient[left].sum() ** 2 / (weight[left].sum() + 1) + gradient[~left].sum() ** 2 / (weight[~left].sum() + 1) - total
            if gain > best:
                best, found = gain, (f, float(cut))
    return found


def grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int):
    cut = split(x, gradient, weight) if depth and len(x) > 20 else None
    if cut is None:
        return round(RATE * leaf(gradient, weight), 5)
    left = x[:, cut[0]] <= cut[1]
    return [cut[0], cut[1], grow(x[left], gradient[left], weight[left], depth - 1), grow(x[~left], gradient[~left], weight[~left], depth - 1)]


def value(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], value(tree[2], x), value(tree[3], x))


def train() -> dict:
    x, y, _ = sample(TRAIN_ROWS, SEED)
    score, trees = np.zeros(len(x)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = grow(x, y - p, p * (1 - p), 3)
        trees.append(tree)
        score += value(tree, x)
    x, y, kinds = sample(CALIBRATION_ROWS, SEED + 1)
    score, thresholds = sum(value(t, x) for t in trees), {}
    for kind in EXTRA_KINDS:
        own = np.array([k == kind for k in kinds])
        order = np.argsort(-score[own], kind="stable")
        ranked, labels = score[own][order], y[own][order]
        precise = np.flatnonzero((np.cumsum(labels) / np.arange(1, len(labels) + 1) >= PRECISION) & np.append(ranked[:-1] != ranked[1:], True))
        if len(precise):  # half-way to the next score below, and never one that is rather none
            lowest = float(ranked[precise[-1]])
            below = ranked[ranked < lowest]
            thresholds[kind] = round(max(0.0, (lowest + float(below[0])) / 2 if len(below) else lowest), 5)
        else:
            thresholds[kind] = 99.0
    x, y, kinds = sample(CALIBRATION_ROWS, SEED + 2)
    score, report = sum(value(t, x) for t in trees), {}
    for kind in EXTRA_KINDS:
        own = np.array([k == kind for k in kinds])
        chosen = own & (score >= thresholds[kind])
        report[kind] = {"precision": round(float(y[chosen].mean()), 3) if chosen.any() else None, "recall": round(float(y[chosen].sum() / y[own].sum()), 3)}
    return {"features": FEATURES, "trees": trees, "thresholds": thresholds, "held_out": report}


if __name__ == "__main__":
    path = Path(__file__).with_name("pii_model.json")
    path.write_text(json.dumps(train(), separators=(",", ":")) + "\n")
    print(path, path.stat().st_size)
