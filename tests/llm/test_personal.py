"""Personal data: rules against plain patterns, messages against enumeration, and what repetitions add."""

import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest

from factorlab.llm import personal as P
from factorlab.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    """The contract's patterns and checks, as they are written."""
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            fine = (kind == 0 or kind == 1 and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == 2 and 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
                    or kind == 3 and 9 <= len(digits) <= 15)
            if fine:
                found.append((kind, m.start(), m.end()))
    return found


def line(spans):
    return ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in spans)


def test_query_holds_the_base(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = QUERIES["op12_personal"](spark, MIDDLE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(b[0] == i for b in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(line(base).encode()).hexdigest()
        assert set(line(base).split(",")) <= set(r["spans"].split(","))
        assert base or not r["spans"]  # nothing in documents without personal data


def test_rules_equal_patterns_on_noise():
    chance = random.Random(7)
    for _ in range(3000):
        alphabet = chance.choice(["0123456789. ", "ab1@.-", "+0123 ().-x", "0 1-", "a@.+1é 5"])
        text = "".join(chance.choice(alphabet) for _ in range(chance.randrange(60)))
        assert sorted(P.matches(text)[0]) == plain_spans(text), text


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000 + "@", "1." * 400_000, "+1 " + " " * 900_000, "a.b_c" * 200_000 + "1",
                                  "@" * 500_000, "a@b" * 300_000, "1 2" * 300_000, "x1-" * 300_000, "(" * 500_000 + "1"])
def test_long_texts_take_time_in_proportion(text):
    started = time.monotonic()
    passed, failed = P.matches(text)
    P.graph(text, passed, failed)
    assert time.monotonic() - started < 20


def enumerated(b, model):
    """Marginals by summing over all labellings."""
    own = model.own[b.features].sum(axis=1)
    weights = np.zeros((len(own), P.LABELS))
    for labels in itertools.product(range(P.LABELS), repeat=len(own)):
        total = sum(own[i, k] for i, k in enumerate(labels))
        total += sum(model.chain[labels[i], labels[i + 1]] for i in np.flatnonzero(b.chained))
        for u, v, why in b.links:
            if labels[u] == labels[v]:
                k = labels[u]
                total += model.alike[why, k] + (model.shared[k] if k and k in (b.rule[u], b.rule[v]) else 0)
        for i, k in enumerate(labels):
            weights[i, k] += np.exp(total)
    return weights / weights.sum(axis=1, keepdims=True)


def test_messages_are_exact_without_loops_and_near_with_them():
    model = P.Model()
    model.chain[:] = np.random.default_rng(0).normal(0, 1, model.chain.shape)
    tree = "call +1 (323) 555-9830 or 4521940886194967"
    loops = "first 555-9830, then 555-9830 and 555-9830; +1 (323) 555-9830"
    for text, close in ((tree, 1e-6), (loops, 0.1)):
        b = P.joined([P.graph(text, *P.matches(text))])
        assert len(b.features) >= 4 and np.abs(P.marginals(b, model, 60) - enumerated(b, model)).max() < close
    assert len(b.links) >= 4


def test_documents_do_not_touch_each_other():
    model, texts = P.Model(), ["mail jo.99@mail5.example.com", "jo.99 and 12", None, "", "jo.99@mail5.example.com or jo.99 (at) mail5.example.com"]
    alone = [P.find([t], model)[0] for t in texts]
    assert P.find(texts, model) == alone and alone[1] == alone[2] == ([], [])


def test_hidden_repetitions_are_added(spark):
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text")
    model = P.fit(rows)
    cases = {
        "Call +1 (323) 555-9830 now. Later he wrote 323-555-9830 again.": ["phone:43:55"],
        "Call +1 (323) 555-9830 now. Later he wrote (323) 555-9830 again.": ["phone:43:57"],
        "Pay with 4521940886194967 or so; the slip says 4521.9408.8619.4967 too.": ["card:47:66"],
        "Write to that.92@mail2.example.com, that is that.92 in short.": ["email:44:51"],
    }
    for text, more in cases.items():
        base, all_ = P.find([text], model)[0]
        assert line(base).split(",") == line(plain_spans(text)).split(",")
        assert [x for x in line(all_).split(",") if x not in line(base).split(",")] == more, text
    clean = ["Licensed under CC BY-NC 4.0.", "the GNU General Public License, version 3.", "Room 12, 3rd floor, 2024-05-06, 17:30, 99.5 %",
             'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', "order 1234567890123456 of 300.1.2.3 at 1,234,567.89", "a@b and c@ d.e", "12:30 1,234,567 and phone 323-555-9830"]
    assert [P.find([t], model)[0] for t in clean] == [([], [])] * len(clean)


def test_redacted_and_awkward_texts(spark, awkward, nothing):
    model = P.fit(awkward)
    out = P.spans(awkward, model)
    rows = out.collect()
    assert len(rows) == awkward.count() and all(r["base"] == [] and r["bucket"] is not None for r in rows if r["doc_id"] != 4)
    assert P.spans(nothing, P.fit(nothing)).count() == 0
    docs = spark.createDataFrame([(1, "An ip 10.0.0.1, and é +1 (323) 555-9830.", "b", 2), (2, None, None, None), (None, "", "b", 1)],
                                 "doc_id bigint, text string, base string, row int")
    done = P.redacted(docs, model)
    assert done.columns == docs.columns
    assert {r["doc_id"]: tuple(r)[1:] for r in done.collect()} == {1: ("An ip [ip], and é [phone].", "b", 2), 2: (None, None, None), None: ("", "b", 1)}


def test_groups_of_repeated_tokens_have_few_links():
    text = "see 12-34-56 " * 2000
    g = P.graph(text, *P.matches(text))
    assert len(g.starts) == 2000 and len(g.links) < 3 * 2000
