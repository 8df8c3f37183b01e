"""Personal data by rules and a skip-chain conditional random field.

Rules give the base: mail addresses, IP addresses, card numbers and phone numbers, as patterns
and checks. They stay as they are. The field labels every token that could belong to such data
(runs of address characters with a digit or an at sign, and dotted names where mail addresses
are) and adds what a document says again in a form that no rule matches.

A token's own potentials come from its shape, the words around it and what the rules say of it.
Tokens side by side are linked in a chain. Distant tokens are linked if they are equal, if the
numbers they belong to end in the same nine digits, or if one is the local part of the other's
address; such a link prefers equal labels, more so where a rule has matched one of its ends.
A group of repeated tokens is linked one to the next and each to a hub that a rule matched, if
any: links grow in proportion to tokens, and evidence is two links away at most. Loopy
sum-product messages, a fixed number of rounds, give each token's marginals. Tokens that no
rule matched and that reach ``SURE`` for one kind, side by side, are one added span if one of
them is linked to a match of that kind: shape alone, learned from few kinds of numbers, is no
proof, so documents without personal data stay as they are.

Weights are learned on a bounded sample from the rules' own matches, by pseudo-likelihood with
a Gaussian prior: every other match is hidden from the features, so that the field learns how
such data look and how their repetitions hang together.

Null and empty texts have no spans. Long texts are read whole, in time that grows with their
length. Rows are read one by one, so repeated ones get the same spans. Without documents to
learn from, the weights are those of the prior. Columns with names of the results give way to
them, others pass through. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import pickle
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.llm.common import add_columns, values

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
#: Documents that are learned from, at most, and tokens of one and of all of these.
SAMPLE, SAMPLE_TOKENS, SAMPLE_TOTAL = 4000, 100, 100_000
#: The marginal from which a token is added.
SURE = 0.5
ROUNDS = 20
_DAMPING = 0.5
_STEPS = 250
#: The prior's means: that a token is none, that linked tokens are alike, and more so beside a rule's match.
_NONE, _ALIKE, _SHARED = 2.0, 1.0, 2.0

# --- rules -----------------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are taken whole, so that no start inside one is tried in vain.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses: from each at sign back over the local part and on over the domain."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (ord(c) - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _bare(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _is_card(text: str) -> bool:
    digits = _bare(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


_RULES = ((1, _IP, lambda m: all(map(_small, m.split(".")))), (2, _CARD, _is_card),
          (3, _PHONE, lambda m: 9 <= len(_bare(m)) <= 15))


def matches(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """``(kind, start, end)`` of what the rules find, and of what matches a pattern but fails its check."""
    passed, failed = [], []
    if not text:
        return passed, failed
    if "@" in text:
        passed += [(0, s, e) for s, e in emails(text)]
    if _DIGITS.search(text):
        for kind, pattern, check in _RULES:
            for m in pattern.finditer(text):
                (passed if check(m.group()) else failed).append((kind, m.start(), m.end()))
    return passed, failed


# --- tokens, features and links --------------------------------------------------------------

_TOKEN = re.compile(r"(?<![A-Za-z0-9@._%+()-])[A-Za-z._%+()-]*+[0-9@][A-Za-z0-9@._%+()-]*+")
_ANY = re.compile(r"[A-Za-z0-9@._%+()-]+")
_NAME = re.compile(r"[A-Za-z]{2}[._][A-Za-z]{2}|[0-9@]")
_GAP = re.compile(r"[ ,;:/|-]{0,3}|[ ]*[\[(]?[ ]*at[ ]*[\])]?[ ]*", re.IGNORECASE)
_BEFORE = re.compile(r"([^\W\d_]+)\W*\Z")
_AFTER = re.compile(r"\W*([^\W\d_]+)")
_NEAR = 24
_EDGE = "._%-+()"
_RUNS = re.compile(r"[0-9]+|[A-Za-z]+")
_SHAPES, _WORDS = 512, 1024

#: Where each group of features begins; a token has one of every group but evidence and refusals.
_SIZES = {"bias": 1, "rule": 1 + len(KINDS), "refused": 1 + len(KINDS), "digits": 12, "letters": 4, "dots": 5, "dashes": 3,
          "signs": 3, "first": 6, "brackets": 2, "left": 2, "right": 2, "longest": 6, "shape": _SHAPES,
          "before": _WORDS + 1, "after": _WORDS + 1}
_AT = dict(zip(_SIZES, np.cumsum([0, *_SIZES.values()][:-1]).tolist()))
FEATURES = sum(_SIZES.values())
_DIGIT_STEPS = (1, 2, 3, 4, 5, 7, 8, 9, 12, 13, 20)
_LONGEST_STEPS = (1, 2, 4, 5, 13)


def _step(n: int, steps) -> int:
    return sum(n >= s for s in steps)


def _hash(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


@dataclass
class Graph:
    """Tokens of one document, their features and links; ``rule`` and ``refused`` are kinds plus one, or 0."""

    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    rule: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    chained: list[bool] = field(default_factory=list)  # with the next one
    links: list[tuple[int, int, int]] = field(default_factory=list)  # token, token, why


def _overlapping(spans, starts, ends) -> list[int]:
    """For each token the first listed kind, plus one, of ``spans`` that touches it; 0 if none does."""
    out = [0] * len(starts)
    for kind in reversed(range(len(KINDS))):
        at = 0
        mine = [(s, e) for k, s, e in spans if k == kind]
        for i, (start, end) in enumerate(zip(starts, ends)):
            while at < len(mine) and mine[at][1] <= start:
                at += 1
            if at < len(mine) and mine[at][0] < end:
                out[i] = kind + 1
    return out


def graph(text: str, passed, failed) -> Graph:
    g = Graph()
    words = []
    if "@" in text:
        found = (m for m in _ANY.finditer(text) if _NAME.search(m.group()))
    else:
        found = _TOKEN.finditer(text)
    for m in found:
        g.starts.append(m.start())
        g.ends.append(m.end())
        words.append(m.group())
    count = len(words)
    g.rule = _overlapping(passed, g.starts, g.ends)
    refused = _overlapping(failed, g.starts, g.ends)
    g.chained = [i + 1 < count and g.starts[i + 1] - g.ends[i] <= 8
                 and _GAP.fullmatch(text, g.ends[i], g.starts[i + 1]) is not None for i in range(count)]
    for i, word in enumerate(words):
        digits = _DIGITS.findall(word)
        letters = sum(c.isalpha() for c in word)
        before = _BEFORE.search(text[max(0, g.starts[i] - _NEAR):g.starts[i]])
        after = _AFTER.match(text[g.ends[i]:g.ends[i] + _NEAR])
        shape = _RUNS.sub(lambda m: "a" if m.group()[0].isalpha() else str(_step(len(m.group()), _DIGIT_STEPS)) + "9", word)
        first = word[0]
        g.features.append([
            _AT["bias"], _AT["rule"] + g.rule[i], _AT["refused"] + refused[i],
            _AT["digits"] + _step(sum(map(len, digits)), _DIGIT_STEPS), _AT["letters"] + _step(letters, (1, 3, 7)),
            _AT["dots"] + min(word.count("."), 4), _AT["dashes"] + min(word.count("-"), 2), _AT["signs"] + min(word.count("@"), 2),
            _AT["first"] + (0 if first.isdigit() else 1 if first.isalpha() else 2 + "+(.".find(first) % 4),
            _AT["brackets"] + ("(" in word), _AT["left"] + (i > 0 and g.chained[i - 1]), _AT["right"] + g.chained[i],
            _AT["longest"] + _step(max(map(len, digits), default=0), _LONGEST_STEPS), _AT["shape"] + _hash(shape, _SHAPES),
            _AT["before"] + (_hash(before.group(1).lower(), _WORDS) if before else _WORDS),
            _AT["after"] + (_hash(after.group(1).lower(), _WORDS) if after else _WORDS)])
    g.links = _links(words, g)
    return g


def _keys(words: list[str], g: Graph) -> dict[tuple[int, str], list[int]]:
    """Tokens by what makes them alike: the word itself, the end of their number, the local part of an address."""
    found: dict[tuple[int, str], list[int]] = {}
    run: list[int] = []
    for i, word in enumerate(words):
        plain = word.lower().replace("(at)", "@").strip(_EDGE)
        if len(plain) >= 6:
            found.setdefault((0, plain), []).append(i)
        local = plain.split("@")[0].strip(_EDGE)
        if len(local) >= 4 and any(c in "0123456789._" for c in local):
            found.setdefault((2, local), []).append(i)
        run.append(i)
        if not g.chained[i]:
            _number_keys(words, run, found)
            run = []
    return found


def _number_keys(words: list[str], run: list[int], found: dict) -> None:
    """The last nine digits of the number that side-by-side tokens make, for the tokens that hold them."""
    digits = [_bare(words[i]) for i in run]
    if sum(map(len, digits)) < 9:
        return
    tail, holders = "", []
    for i, d in zip(reversed(run), reversed(digits)):
        if len(tail) >= 9:
            break
        if d:
            tail = d + tail
            holders.append(i)
    for i in reversed(holders):
        found.setdefault((1, tail[-9:]), []).append(i)


def _links(words: list[str], g: Graph) -> list[tuple[int, int, int]]:
    links: dict[tuple[int, int], int] = {}
    for (why, _), members in _keys(words, g).items():
        if len(members) < 2:
            continue
        hub = next((i for i in members if g.rule[i]), members[0])
        for a, b in [*zip(members, members[1:]), *((hub, i) for i in members if i != hub)]:
            a, b = min(a, b), max(a, b)
            # tokens side by side belong to one number and are no repetition
            if a < b and not (b == a + 1 and g.chained[a]):
                links.setdefault((a, b), why)
    return [(a, b, why) for (a, b), why in links.items()]


# --- the field -------------------------------------------------------------------------------

_WHY = 3


@dataclass
class Model:
    """Log-potentials: by feature and label, by labels of neighbours, of alike labels by kind of link, beside a rule's match."""

    own: np.ndarray = field(default_factory=lambda: _prior()[0])
    chain: np.ndarray = field(default_factory=lambda: _prior()[1])
    alike: np.ndarray = field(default_factory=lambda: _prior()[2])
    shared: np.ndarray = field(default_factory=lambda: _prior()[3])


def _prior() -> list[np.ndarray]:
    own = np.zeros((FEATURES, LABELS))
    own[_AT["bias"], 0] = _NONE
    for kind in range(1, LABELS):
        own[_AT["rule"] + kind, kind] = 2 * _NONE
        own[_AT["refused"] + kind, kind] = -2 * _NONE
    shared = np.full(LABELS, _SHARED)
    shared[0] = 0.0
    return [own, np.zeros((LABELS, LABELS)), np.full((_WHY, LABELS), _ALIKE), shared]


@dataclass
class Batch:
    """Graphs of several documents as one."""

    features: np.ndarray
    rule: np.ndarray
    chained: np.ndarray
    links: np.ndarray


def joined(graphs: list[Graph]) -> Batch:
    first = np.cumsum([0] + [len(g.starts) for g in graphs])
    links = [np.array(g.links, np.int64).reshape(-1, 3) + [at, at, 0] for g, at in zip(graphs, first)]
    return Batch(np.array([f for g in graphs for f in g.features], np.int64).reshape(-1, len(_SIZES)),
                 np.array([k for g in graphs for k in g.rule], np.int64),
                 np.array([c for g in graphs for c in g.chained], bool), np.concatenate([np.zeros((0, 3), np.int64), *links]))


def _edges(b: Batch, model: Model, rule: np.ndarray):
    """``(from, to, log-potentials)`` of all directed links; the opposite of edge e is e +- half."""
    left = np.flatnonzero(b.chained)
    u, v, why = b.links.T
    alike = model.alike[why]
    alike = alike + model.shared * ((rule[u][:, None] == np.arange(LABELS)) | (rule[v][:, None] == np.arange(LABELS)))
    skip = np.zeros((len(u), LABELS, LABELS))
    skip[:, np.arange(LABELS), np.arange(LABELS)] = alike
    chain = np.broadcast_to(model.chain, (len(left), LABELS, LABELS))
    forth = np.concatenate([chain, skip])
    source, target = np.concatenate([left, u]), np.concatenate([left + 1, v])
    return np.concatenate([source, target]), np.concatenate([target, source]), np.concatenate([forth, forth.transpose(0, 2, 1)])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top


def marginals(b: Batch, model: Model, rounds: int = ROUNDS) -> np.ndarray:
    """Labels' probabilities of every token after ``rounds`` of damped sum-product messages."""
    own = model.own[b.features].sum(axis=1) if len(b.features) else np.zeros((0, LABELS))
    source, target, potentials = _edges(b, model, b.rule)
    half = len(source) // 2
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    sent = np.zeros((2 * half, LABELS))

    def beliefs():
        return own + np.column_stack([np.bincount(target, sent[:, k], len(own)) for k in range(LABELS)])

    for _ in range(rounds if half else 0):
        cavity = beliefs()[source] - sent[back]
        new = _log_sum(cavity[:, :, None] + potentials, 1)[:, 0]
        sent = _DAMPING * sent + (1 - _DAMPING) * (new - _log_sum(new, 1))
    all_ = beliefs() if half else own
    return np.exp(all_ - _log_sum(all_, 1)) if len(all_) else all_


def learn(b: Batch, hidden: np.ndarray, steps: int = _STEPS) -> Model:
    """Weights of highest pseudo-likelihood under the prior, the rules' matches being the labels.

    ``hidden`` marks tokens whose match neither they nor their links may see.
    """
    prior = _prior()
    if not len(b.features):
        return Model(*prior)
    truth, seen = b.rule, np.where(hidden, 0, b.rule)
    features = b.features.copy()
    features[:, 1] = _AT["rule"] + seen
    count, one = len(truth), np.eye(LABELS)
    # what neighbours' labels add to a token's own label, as counts
    left = np.flatnonzero(b.chained)
    from_left, from_right = np.zeros((count, LABELS)), np.zeros((count, LABELS))
    from_left[left + 1], from_right[left] = one[truth[left]], one[truth[left + 1]]
    alike, shared = np.zeros((_WHY, count, LABELS)), np.zeros((count, LABELS))
    u, v, why = b.links.T
    for a, c in ((u, v), (v, u)):
        np.add.at(alike, (why, a, truth[c]), 1.0)
        near = (seen[a] == truth[c]) | (seen[c] == truth[c])
        np.add.at(shared, (a[near], truth[c][near]), 1.0)
    flat = features.ravel()
    params = [p.copy() for p in prior]
    speed, square = [np.zeros_like(p) for p in prior], [np.zeros_like(p) for p in prior]
    for step in range(1, steps + 1):
        own, chain, same, beside = params
        score = (own[features].sum(axis=1) + from_left @ chain + from_right @ chain.T
                 + np.einsum("wnk,wk->nk", alike, same) + shared * beside)
        gap = one[truth] - np.exp(score - _log_sum(score, 1))
        slopes = [np.column_stack([np.bincount(flat, np.repeat(gap[:, k], features.shape[1]), FEATURES) for k in range(LABELS)]),
                  from_left.T @ gap + gap.T @ from_right, np.einsum("wnk,nk->wk", alike, gap), (shared * gap).sum(axis=0)]
        # a failed check speaks against its own kind, not against others
        slopes[0][_AT["refused"]:_AT["refused"] + LABELS] *= np.eye(LABELS)
        for p, q, slope, m, s in zip(params, prior, slopes, speed, square):
            slope = slope - (p - q)  # a Gaussian prior of variance one
            m += 0.1 * (slope - m)
            s += 0.01 * (slope * slope - s)
            p += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)
    return Model(*params)


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` documents, those with the smallest hashes, of at most ``SAMPLE_TOKENS`` tokens each."""
    key = F.xxhash64(F.col(text_col))
    cutoff = docs.where(F.col(text_col).isNotNull()).select(key.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if cutoff is None:
        return Model()

    def graphs(batches):
        for batch in batches:
            made = [graph(t, *matches(t)) for t in values(batch.column(0))]
            made = [tuple(vars(g).values()) for g in made if 0 < len(g.starts) <= SAMPLE_TOKENS]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(g) for g in made], pa.binary())], names=["graph"])

    rows = docs.where(F.col(text_col).isNotNull() & (key <= cutoff)).select(F.col(text_col).alias("t")).limit(sample)
    held, total = [], 0
    for row in sorted(bytes(r["graph"]) for r in rows.mapInArrow(graphs, "graph binary").collect()):
        g = Graph(*pickle.loads(row))
        if total + len(g.starts) <= SAMPLE_TOTAL:
            held.append(g)
            total += len(g.starts)
    b = joined(held)
    return learn(b, np.random.default_rng(1).random(len(b.rule)) < 0.5)


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without punctuation at the ends, but with a leading plus and with brackets that are paired."""
    inside = text[start:end]
    paired = "(" in inside and ")" in inside[inside.find("("):]
    while start < end and text[start] in "._%-)" + ("" if paired else "("):
        start += 1
    while end > start and text[end - 1] in "._%-+(" + ("" if paired else ")"):
        end -= 1
    return start, end


def added(text: str, g: Graph, chance: np.ndarray, sure: float = SURE) -> list[tuple[int, int, int]]:
    """Spans of side-by-side tokens that no rule matched, of one kind and linked to a match of it."""
    backed = {(i, g.rule[j]) for a, b, _ in g.links for i, j in ((a, b), (b, a)) if g.rule[j]}
    best = chance.argmax(axis=1)
    takes = [int(k) if k and p[k] >= sure and not rule else 0 for k, p, rule in zip(best, chance, g.rule)]
    spans, i = [], 0
    while i < len(takes):
        last = i
        if takes[i]:
            while g.chained[last] and takes[last + 1] == takes[i]:
                last += 1
            start, end = _trimmed(text, g.starts[i], g.ends[last])
            if start < end and any((j, takes[i]) in backed for j in range(i, last + 1)):
                spans.append((takes[i] - 1, start, end))
        i = last + 1
    return spans


def find(texts: list[str | None], model: Model) -> list[tuple[list, list]]:
    """``(base, all)`` spans of each text, by kind as listed and start."""
    bases, graphs, at = [], [], []
    for i, text in enumerate(texts):
        passed, failed = matches(text)
        bases.append(sorted(passed))
        g = graph(text, passed, failed) if text and (passed or failed or _DIGITS.search(text)) else None
        if g is not None and g.starts:
            graphs.append(g)
            at.append(i)
    out = [(b, b) for b in bases]
    if graphs:
        chance = marginals(joined(graphs), model)
        upto = 0
        for i, g in zip(at, graphs):
            more = added(texts[i], g, chance[upto:upto + len(g.starts)])
            upto += len(g.starts)
            if more:
                out[i] = bases[i], sorted(bases[i] + more)
    return out


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS_DDL = "array<struct<kind string, start bigint, end bigint>>"
#: Characters of texts that are labelled together.
_TOGETHER = 1 << 22


def spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (kind, start, end), in order of kind and start."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def made(columns: list[pa.Array]) -> list[pa.Array]:
        rows, held, size, field_ = [], [], 0, Model(*shared.value)
        for text in values(columns[0]):
            held.append(text)
            size += len(text or "")
            if size >= _TOGETHER:
                rows += find(held, field_)
                held, size = [], 0
        rows += find(held, field_)
        return [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in row[which]] for row in rows],
                         pa.list_(_SPAN)) for which in (0, 1)]

    return add_columns(docs, [text_col], f"base {_SPANS_DDL}, spans {_SPANS_DDL}", made)


def spelled(column: str):
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in square brackets; overlapping spans by the first one's."""

    def replaced(columns: list[pa.Array]) -> list[pa.Array]:
        out = []
        for text, found in zip(values(columns[0]), values(columns[1])):
            parts, upto = [], 0
            for s in sorted(found, key=lambda x: (x["start"], x["end"])):
                if s["start"] >= upto:
                    parts += [text[upto:s["start"]], f"[{s['kind']}]"]
                upto = max(upto, s["end"])
            out.append("".join([*parts, text[upto:]]) if parts else text)
        return [pa.array(out, pa.string())]

    order = docs.columns
    marked = spans(docs.select(F.col(text_col), F.struct("*").alias("row")), model, text_col)
    done = add_columns(marked, [text_col, "spans"], f"{text_col} string", replaced)
    return done.select(*[F.col(text_col) if c == text_col else F.col(f"row.{c}") for c in order])
