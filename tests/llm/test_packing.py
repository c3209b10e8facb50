"""Packing: every id in one piece, no overlap, little padding, encoding as by the tokenizer."""

import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm.packing import balance, op7_packing, pack_documents
from marlstone.llm.tokens import WordEncoder, default_vocabulary, encoder


def plain_ids(texts):
    tokenizer = Tokenizer.from_file(default_vocabulary())
    return [np.array([*e.ids, 1], dtype="<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(pieces, ids, capacity, crc):
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        own = ids[p.doc_id][p.start : p.start + p.length].tobytes()
        assert (zlib.crc32(own) == p.ids_crc32) if crc else (own == bytes(p.ids))
        assert p.doc_tokens == len(ids[p.doc_id])
    for doc_id, own in ids.items():
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(own)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return sequences


def test_query_on_documents(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([r.doc_id for r in rows], plain_ids([r.text for r in rows]), strict=True))
    sequences = check(op7_packing(spark, small).collect(), ids, 2048, True)
    assert len(sequences) == -(-sum(map(len, ids.values())) // 2048)


def test_odd_rows(spark):
    texts = [None, "", " \n", "one", "Long " * 9000, "x" * 5000, "a\x01b. \x01", "İ ΑΣ é. <|endoftext|>, it's", "ends. ends, ends"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, start long").coalesce(1)
    ids = dict(enumerate(plain_ids(texts)))
    check(pack_documents(docs, capacity=64).collect(), ids, 64, False)
    check(pack_documents(docs, capacity=64, window_pieces=2).collect(), ids, 64, False)
    assert pack_documents(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b"), (3, "b")], "doc_id long, text string")
    assert pack_documents(twice).count() == 4


def test_costs_are_balanced():
    lengths = np.random.default_rng(1).integers(1, 1500, 3000)
    cost = defaultdict(float)
    room = defaultdict(int)
    for _, _, length, sequence, _ in balance(lengths, 2048, 1.0, 1 / 2048):
        cost[sequence] += length + length * length / 2048
        room[sequence] += length
    assert len(room) == -(-lengths.sum() // 2048) and max(room.values()) <= 2048
    assert np.std(list(cost.values())) / np.mean(list(cost.values())) < 0.2


def test_encoder_equals_tokenizer_after_forgetting():
    words = encoder(default_vocabulary(), False)
    texts = ["Some WORDS, some words. it's", "DON'T stop!", "tab\tand\nline  two", "½² 3.5 a.b ..."]
    for _ in range(2):
        assert [x + b"\x01\0\0\0" for x in words.encode(texts)] == [x.tobytes() for x in plain_ids(texts)]
        words.forget()


def test_marks_of_the_vocabulary_get_the_ids_of_the_plain_call(spark, tmp_path):
    texts = [
        "a <|endoftext|> b",
        "<|startoftext|>One<|endoftext|><|endoftext|>.",
        "<|ENDOFTEXT|> <|endof text|> <|<|endoftext|>|>",
        "É e<|endoftext|>\u0301 İ<|startoftext|>ΑΣ, it<|endoftext|>'s",
        "no mark. " * 50,
        "x" * 100 + "<|endoftext|>" + "y" * 100,
        "a\x01<|endoftext|>\x01 b.",
    ]
    tokenizer = Tokenizer.from_file(default_vocabulary())
    ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], dtype="<u4") for i, t in enumerate(texts)}
    assert ids[0].tolist() == [320, 49407, 321, 1]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    check(op7_packing(spark, str(tmp_path)).collect(), ids, 2048, True)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    check(corpus_pipeline.pack(spark, docs, str(tmp_path)).collect(), ids, 2048, False)


#: What joins, splits, folds or composes with its neighbours, and what does not.
PARTS = [*"abcXYZ019 '.,;:!?-_/\n\t\r\x0b\x01\x00\x85\xa0\u2003\u0301\u0307\u0308iI\u0130\u0131\u00df\u0149\u01f0\u03c3\u03c2\u03a3\u015f\u00b2\u00bd\u2177\u0663\u304b\u3099\uac00\u1100\u1161\U0001f600\u200d\u212b\ua7d0"]
PARTS += ["'s", "'re", "'LL", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "\u0130,", "A\u030a", "the", "The", "don't", "word,", "e.g."]


def test_random_odd_strings_get_the_ids_of_the_plain_call():
    random_ = random.Random(5)
    texts = ["KAR\u015eI \u0130, ve", *("".join(random_.choices(PARTS, k=random_.randint(1, 40))) for _ in range(5000))]
    words = encoder(default_vocabulary(), False)
    got = [x + b"\x01\0\0\0" for at in range(0, len(texts), 500) for x in words.encode(texts[at : at + 500])]
    assert got == [x.tobytes() for x in plain_ids(texts)]


def test_words_met_again_are_encoded_once(monkeypatch):
    """A full cache keeps the words of its last generation that are met again, and stays bounded."""
    words, done = WordEncoder(default_vocabulary(), False), []
    monkeypatch.setattr(words, "MAX_WORDS", 40)
    monkeypatch.setattr(words, "_encode_words", lambda new: done.extend(new) or WordEncoder._encode_words(words, new))
    texts = [f"the same words, again! {' '.join(chr(97 + n) * k for k in range(2, 14))}" for n in range(26)]
    plain = [WordEncoder(default_vocabulary(), False).encode([t])[0] for t in texts[:3]]
    got = [words.encode([t])[0] for t in texts]
    assert got[:3] == plain and words.encode(texts)[:3] == plain
    got = done[: done.index("zz")]
    assert got.count("same") == got.count("again") == got.count("the") == 1
    words.encode(texts[:1])
    assert len(words._ids) + len(words._before) < 1000 and words.forget() is None and not words._before


def test_words_in_any_case_and_with_marks_are_encoded_once(monkeypatch):
    """Also in a text that is not of ASCII alone, where the words' case was part of what had been seen."""
    words, done = WordEncoder(default_vocabulary(), False), []
    monkeypatch.setattr(words, "_encode_words", lambda new: done.extend(new) or WordEncoder._encode_words(words, new))
    texts = ["same Same, SAME!! Same%%% été Été. ÉTÉ", "Same) same", "SAME... été?!"]
    assert [x + b"\x01\0\0\0" for x in words.encode(texts)] == [x.tobytes() for x in plain_ids(texts)]
    assert done.count("same") == done.count("été") == 1 and not {"Same", "SAME", "Été"} & set(done)


def test_every_old_latin_letter_and_mark_gets_the_ids_of_the_plain_call():
    marks = ["", ".", "'", "!?", "...", "%%%%", "|>", "'s", "̇", "̱."]
    texts = [f"{c}{m} H{c}{m} {c}'S{m} 1{c}É{m} É" for c in map(chr, range(0x260)) for m in marks]
    got = [x + b"\x01\0\0\0" for x in WordEncoder(default_vocabulary(), False).encode(texts)]
    assert got == [x.tobytes() for x in plain_ids(texts)]
