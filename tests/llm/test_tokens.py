import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from edges import documents

import __spark_entry__ as entry_mod
from dyadic.llm import prefix_bpe
from dyadic.llm.common import read

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    with open(PATH, "rb") as f:
        return prefix_bpe.PrefixCoder(prefix_bpe.Vocabulary.parse(f.read()), PATTERN)


@pytest.fixture(scope="module")
def plain(coder):
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=coder.vocabulary.ids, special_tokens={})


def words(rnd, n):
    bits = ["a", "b", " ", "'", "r", "e", "\n", "1", "é", "中", "!", "ll", "  ", "\t", "the", "ing", "\U0001f600"]
    return "".join(rnd.choice(bits) for _ in range(n))


def test_tokens_fit_as_merging_says(coder):
    v, rnd = coder.vocabulary, random.Random(1)
    tokens = list(v.tokens)
    runs = [i for i, t in v.tokens.items() if len(set(t)) == 1]
    pairs = [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(3000)] + [(a, b) for a in runs[-40:] for b in runs[-40:]]
    for a, b in pairs:
        both = [v.tokens[a], v.tokens[b]]
        assert v.fits[a << 32 | b] == (prefix_bpe.merge_by_rank(b"".join(both), v.ids) == both)


def test_every_prefix_has_its_last_token(coder, plain):
    data = (" antidisestablishmentarianismically" * 3).strip().encode()
    last = []
    coder.extend(last, data)
    for k in range(1, len(data) + 1):
        want = prefix_bpe.merge_by_rank(data[:k], coder.vocabulary.ids)
        assert coder.vocabulary.tokens[last[k - 1]] == want[-1]
        assert [coder.vocabulary.tokens[t] for t in coder.tokens_of(last[:k])] == want


def test_texts_encode_as_the_library_does(coder, plain, monkeypatch):
    rnd = random.Random(2)
    texts = [words(rnd, rnd.randrange(60)) for _ in range(400)]
    texts += ["", "y" * 3000, " " * 900 + "x", "a'" + "'re" * 50, "<|endoftext|>", "\n\n \t x ", "中" * 500, "=" * 333]
    for _ in range(2):
        for t in texts:
            packed = coder.encode(t)
            assert np.frombuffer(packed, "<u4").tolist() == plain.encode_ordinary(t)
            assert coder.decode(packed) == t.encode()
        monkeypatch.setattr(prefix_bpe, "ENTRIES", 10)  # tables emptied again and again


def test_edits_and_appends(coder, plain):
    rnd = random.Random(3)
    for _ in range(1500):
        text = words(rnd, rnd.randrange(40))
        starts, entries = coder.prefixes(text)
        at = rnd.choice([len(text), rnd.randrange(len(text) + 1)])
        removed, inserted = rnd.randrange(len(text) - at + 1), words(rnd, rnd.randrange(5))
        new, starts, entries = coder.edit_text(text, starts, entries, at, removed, inserted)
        assert new == text[:at] + inserted + text[at + removed:]
        assert (starts, entries) == coder.prefixes(new)
        assert [t for e in entries for t in coder.tokens_of(e)] == plain.encode_ordinary(new)


def test_an_edit_leaves_distant_prefixes_alone(coder):
    rnd = random.Random(4)
    data = bytes(rnd.choice(b"ab thein") for _ in range(4000))
    last = []
    coder.extend(last, data)
    out, computed = coder.reencode(last, data, 1000, 2, b"xyz")
    fresh = []
    coder.extend(fresh, data[:1000] + b"xyz" + data[1002:])
    assert out == fresh and computed < 200
    assert coder.reencode(last, data, 4000, 0, b"q")[1] == 1


def test_vocabularies_are_checked(tmp_path, spark, monkeypatch):
    byte = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError):
        prefix_bpe.Vocabulary({b"a": 0})
    with pytest.raises(ValueError):
        prefix_bpe.Vocabulary(byte | {b"abc": 300})  # no two lower tokens make it
    monkeypatch.setattr(prefix_bpe, "MAX_VOCABULARY_BYTES", 10)
    with pytest.raises(ValueError):
        prefix_bpe.ship_vocabulary(spark, PATH)


def digests(plain, text):
    ids = plain.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_query_against_the_library(spark, sf_dir, plain):
    got = entry_mod.queries()["op13_prefix_bpe"](spark, sf_dir)
    want = sorted((r.doc_id, *digests(plain, r.text)) for r in read(spark, sf_dir, "documents").collect())
    assert sorted(map(tuple, got.collect())) == want
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_awkward_documents(spark, plain):
    docs = documents(spark).withColumnRenamed("size", "n_tokens")
    got = prefix_bpe.token_digests(docs, PATH, PATTERN).collect()
    want = [(r.doc_id, *digests(plain, r.text)) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert prefix_bpe.token_digests(docs.limit(0), PATH, PATTERN).count() == 0


def test_stored_encodings_take_edits(spark, plain):
    docs = documents(spark)
    stored = prefix_bpe.encode(docs, PATH, PATTERN)
    assert sorted(repr((r.doc_id, plain.encode_ordinary(r.text or ""))) for r in docs.collect()) == sorted(
        repr((r.doc_id, r.ids)) for r in stored.collect())
    back = prefix_bpe.decode(stored, PATH, PATTERN)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((r.text or "").encode() for r in docs.collect())
    edits = stored.selectExpr("*", "case doc_id when 9 then null when 1 then 4 else length(text) end as at",
                              "case doc_id when 1 then 5 else 0 end as removed", "' and moré'  as inserted")
    changed = prefix_bpe.reencode(edits, PATH, PATTERN)
    again = prefix_bpe.encode(changed.select("doc_id", "text"), PATH, PATTERN)
    assert sorted(map(repr, changed.collect())) == sorted(map(repr, again.collect()))
    assert {r.doc_id: r.text for r in changed.collect()}[8] == "ünïcode £ 12 é and moré"
    assert prefix_bpe.reencode(edits.limit(0), PATH, PATTERN).count() == 0
