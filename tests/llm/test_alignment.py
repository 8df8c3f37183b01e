"""Alignment of two tokenizers against a plain version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from factorlab.llm import alignment
from factorlab.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
FOLDER = alignment.TOKENIZERS


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    _, a_bytes = alignment.ByteLevel(alignment.read(f"{FOLDER}/byte_bpe_50k.json")).load()

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def groups(text):
        """Lists of A ids and of B ids between the byte offsets at which tokens of both end."""
        if not text:
            return []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [a_bytes[i] for i in ids[0]], [piece(i) for i in ids[1]]
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            return []
        found, (i, j), (x, y) = [([], [])], (0, 0), (0, 0)
        while i < len(ids[0]) or j < len(ids[1]):
            if x <= y and i < len(ids[0]):
                x += len(parts[0][i])
                found[-1][0].append(ids[0][i])
                i += 1
            else:
                y += len(parts[1][j])
                found[-1][1].append(ids[1][j])
                j += 1
            if x == y:
                found.append(([], []))
        return found[:-1]
    return groups


def expected(texts, groups):
    """The rows of the query, from all links of all documents."""
    made = {i: groups(t) for i, t in texts.items()}
    links = {i: Counter((a, b) for g in found for a in g[0] for b in g[1]) for i, found in made.items()}
    docs = Counter(pair for c in links.values() for pair in c)
    best = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    out = {}
    for i, found in made.items():
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found)
        out[i] = (sum(len(x) for x, _ in found), sum(len(y) for _, y in found), len(found), links[i].total(),
                  sum(n for p, n in links[i].items() if docs[p] == best[p[0]]), sum(n * docs[p] for p, n in links[i].items()),
                  hashlib.sha256(line.encode()).hexdigest() if found else "")
    return out


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_equals_plain_version(spark, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_alignment"](spark, SMALL).collect()}
    assert got == expected(texts, plain)


HARD = ["<|endoftext|> and <s> </s> <unk> <0x41>", "▁ blank of the model", "  two  blanks \n\n\t tabs ", "\x00\x01\x7f",
        "\U0001f600\U0001f468‍\U0001f469‍\U0001f467 日本語の文", "ﬁ Å é  x",
        "a" * 3000, "ab" * 999 + " ", " ", "\n", "0123456789" * 50, "กำำ" * 40, "x\u0085y z　w"]


def test_hard_texts_and_both_ways_of_counting(spark, plain, monkeypatch):
    texts = dict(enumerate(HARD)) | {100: None, 101: "", 102: "Lower case and UPPER case, 12.5 %. " * 400, 103: "Lower case"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    sides = alignment.tokenizers()
    want = expected(texts, plain)
    monkeypatch.setattr(alignment, "_EXPAND", 50)
    monkeypatch.setattr(alignment, "BATCH_CHARS", 300)
    made = alignment.align(frame, *sides)
    for most in (alignment.BROADCAST_PAIRS, 0):
        rows = alignment.score(made, most).collect()
        assert {r["doc_id"]: (*[r[c] for c in COLUMNS[:-1]], r["groups"]) for r in rows} == want
    assert all(want[i][:3] == (0, 0, 0) for i in (100, 101))


def test_pieces_of_long_texts_encode_like_the_whole(plain):
    chance = random.Random(3)
    words = ["word", "über", "it's", "12", "a.b", "--", "  ", "\n", "日", "x-y", "end."]
    text = " ".join(chance.choice(words) for _ in range(3000))
    pieces = alignment.pieces_of(text, 500)
    assert len(pieces) > 10 and "".join(pieces) == " " + text
    for side in alignment.tokenizers():
        encode, _ = side.load()
        assert [i for ids in encode(pieces) for i in ids] == list(encode([" " + text])[0])


def test_each_different_word_is_encoded_once(plain, monkeypatch):
    chance = random.Random(4)
    words = ["word", "über", "12", "a.b", "日本", "it's", "x  y", "\n", "<s>", "end."]
    texts = [" ".join(chance.choice(words) for _ in range(60)) for _ in range(200)] + HARD + [None, ""]
    a, b = alignment.tokenizers()
    want = [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain(t)) for t in texts]
    for bound in (alignment.WORD_CHARS, 30):
        monkeypatch.setattr(alignment, "WORD_CHARS", bound)
        monkeypatch.setattr(alignment, "BATCH_CHARS", 500)
        batch, given = alignment._Batch(a, b, True), []
        batch.words = alignment._Words(a, b)
        encode, spelled, lengths = batch.words.sides[1]
        batch.words.sides = batch.words.sides[0], (lambda p: (given.extend(p), encode(p))[1], spelled, lengths)
        assert batch.run(pa.array(texts))[4].to_pylist() == want
        assert (len(given) == len(set(given))) == (bound > 30)


def test_coalesced_groups_cover_the_same_bytes():
    chance = np.random.default_rng(5)
    for _ in range(50):
        size = int(chance.integers(1, 60))
        sides = [np.unique(np.append(chance.integers(1, size + 1, chance.integers(0, 40)), size)) for _ in range(2)]
        groups = alignment.coalesce(*sides)
        common = np.intersect1d(*sides)
        assert all((g == np.searchsorted(common, ends)).all() for g, ends in zip(groups, sides))


def test_awkward_alignment(awkward, nothing, plain):
    sides = alignment.tokenizers()
    made = alignment.align(awkward, *sides, spelled=True)
    rows = alignment.score(made).collect()
    assert len(rows) == awkward.count() and all(r["lang"] in ("en", "de", None) and r["bucket"] is not None for r in rows)
    same = [r for r in rows if r["doc_id"] in (0, 1)]
    assert len(same) == 3 and len({(r["groups"], r["count_sum"]) for r in same}) == 1
    text = "A text without an id, but with words in it."
    line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain(text))
    assert sorted(r["groups"] for r in rows if r["doc_id"] is None) == ["", line]
    assert max(r["docs"] for r in made.counts().collect()) >= 3
    assert alignment.score(alignment.align(nothing, *sides)).count() == 0
