"""Encoding of whole texts with public vocabulary files, for use inside tasks."""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOADED: dict[tuple[str, bool], "WordEncoder"] = {}


def default_vocabulary() -> str:
    """Path of the vocabulary whose pre-tokenizer drops white space."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids, word by word with a bounded cache.

    Only for vocabularies that drop white space and never join words across it: there the ids of a
    text are those of its words, one after the other, and most words have been seen before. Each
    word of a call is looked up once, however often it occurs. New words go through the tokenizer
    many at a time, with a mark between them.

    Without ``specials_are_text``, the vocabulary's added tokens are found in the raw text and give
    their own ids, as by the library's default.
    """

    #: Words in a generation of the cache; beyond that a new one begins. Words met again come over from the one before, which then goes.
    MAX_WORDS = 350_000
    #: Longer words are rare, so keeping them would not pay.
    MAX_CHARS = 64
    #: A control character that makes one token of its own; words that hold it are encoded alone.
    MARK = "\x01"
    #: Words without the marks at their end are encoded in lower case and apart from those, if they are
    #: of characters of old Latin blocks, where all tables agree and no mark combines, and end in a letter or digit.
    OLD = r"^[\x00-\x{12F}\x{131}-\x{24F}]*$"
    STEM = r"[\p{L}\p{N}]$"
    #: More marks at the end are left on the word.
    MARKS = 3
    #: New words that are encoded as one text.
    JOINED = 500

    def __init__(self, path: str, specials_are_text: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        # words never hold added tokens: those are taken out before, so what lower-casing makes one stays text
        self._tokenizer.encode_special_tokens = True
        added = {} if specials_are_text else self._tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word for t in added.values()):
            raise ValueError("added tokens that are matched as single words or in normalized text are not supported")
        self._added = {t.content: self._bytes([i]) for i, t in added.items()}
        longest = sorted((t.content for t in added.values()), key=len, reverse=True)
        self._added_in = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        mark = self._tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self._mark = mark[0] if len(mark) == 1 else None
        self.forget()
        # words of lower-case letters need no normalizing and are one pre-token each, whose last id is known as such
        self._letters, self._last = Tokenizer.from_file(path), None
        if suffix := getattr(self._letters.model, "end_of_word_suffix", None):
            self._letters.encode_special_tokens = True
            self._letters.normalizer = normalizers.Sequence([])
            self._letters.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            vocabulary = self._letters.get_vocab()
            self._last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self._last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as bytes; nothing for null and for texts without tokens."""
        # added tokens are every other part of a text
        cut = [self._added_in.split(t) if t and self._added_in else [t or ""] for t in texts]
        own = iter(self._encode_parts([part for parts in cut for part in parts[::2]]))
        return [next(own) if len(parts) == 1 else b"".join([self._added[p] if n % 2 else next(own) for n, p in enumerate(parts)]) for parts in cut]

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pa.array([self._spaced(p) for p in parts], pa.large_string()), " ")
        words = split.values.dictionary_encode()
        cut = [x.dictionary_encode() for x in self._cut(words.dictionary)]
        known = [pa.array(self._ids_of(_listed(x.dictionary)), pa.large_binary()).take(x.indices) for x in cut]
        ids = pc.binary_join_element_wise(*known, pa.scalar(b"", pa.large_binary())).take(words.indices)
        _, places, data = ids.buffers()
        bounds = np.frombuffer(places, dtype=np.int64)[split.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        return [bytes(data[start:end]) for start, end in zip(bounds, bounds[1:])]

    def _cut(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Two parts of each word whose ids, one after the other, are its own."""
        stems, none = pc.utf8_rtrim(words, string.punctuation), pa.scalar("", words.type)
        marks = pc.subtract(pc.binary_length(words), pc.binary_length(stems))
        apart = pc.and_(pc.match_substring_regex(stems, self.OLD), pc.match_substring_regex(stems, self.STEM))
        apart = pc.and_(apart, pc.less_equal(marks, self.MARKS))
        ends = pc.if_else(pc.equal(marks, 1), pc.utf8_slice_codeunits(words, -1), none)
        for n in range(2, self.MARKS + 1):
            ends = pc.if_else(pc.equal(marks, n), pc.utf8_slice_codeunits(words, -n), ends)
        return pc.if_else(apart, pc.utf8_lower(stems), words), pc.if_else(apart, ends, none)

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of each of ``words``, which differ."""
        if len(self._ids) > self.MAX_WORDS:
            before = self._ids
            self.forget()
            self._before = before
        ids, before = self._ids, self._before
        found = list(map(ids.get, words))
        new = [n for n, known in enumerate(found) if known is None]
        if before:
            for n in new:
                if (known := before.get(words[n])) is not None:
                    found[n] = ids[words[n]] = known
            new = [n for n in new if found[n] is None]
        unseen = [words[n] for n in new]
        alone = [w for w in unseen if len(w) > self.MAX_CHARS or self.MARK in w or self._mark is None]
        long = {w: self._bytes(e.ids) for w, e in zip(alone, self._encode_texts(alone), strict=True)}
        ids.update(self._encode_words([w for w in unseen if w not in long]))
        for n in new:
            found[n] = long[words[n]] if words[n] in long else ids[words[n]]
        return found

    @staticmethod
    def _spaced(text: str) -> str:
        """Any subset of white space is a safe place to cut, and ASCII knows but one lower case."""
        text = text.replace("\n", " ").replace("\t", " ")
        return text.lower() if text.isascii() else text

    def forget(self) -> None:
        """Free the cache, so that idle workers hold no memory."""
        self._ids: dict[str, bytes] = {"": b""}
        self._before: dict[str, bytes] = {}

    def _encode_texts(self, texts: list[str]) -> list:
        return self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _encode_words(self, words: list[str]) -> Iterable[tuple[str, bytes]]:
        letters = [w for w in words if self._is_plain(w)] if self._last is not None else []
        yield from self._encode_joined(letters, self._letters, " ")
        plain = set(letters)
        yield from self._encode_joined([w for w in words if w not in plain], self._tokenizer, f" {self.MARK} ")

    @staticmethod
    def _is_plain(word: str) -> bool:
        """Whether ``word`` is of lower-case letters that all tables of letters know: Latin, Greek and Cyrillic ones."""
        if not word.isalpha() or word != word.lower():
            return False
        return word.isascii() or (max(word) < "\u0500" and unicodedata.is_normalized("NFC", word))

    def _encode_joined(self, words: list[str], tokenizer, between: str) -> Iterable[tuple[str, bytes]]:
        parts = [words[at : at + self.JOINED] for at in range(0, len(words), self.JOINED)]
        for at in range(0, len(parts), 16):
            texts = [between.join(p) for p in parts[at : at + 16]]
            encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for own, got in zip(parts[at : at + 16], encoded, strict=True):
                flat = np.array(got.ids, dtype="<u4")
                if between == " ":
                    ends = np.flatnonzero(self._last[flat]) + 1
                else:
                    marks = np.flatnonzero(flat == self._mark)
                    flat = np.delete(flat, marks)
                    ends = np.append(marks - np.arange(len(marks)), len(flat))
                offsets = np.append(0, ends * 4)
                cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(flat.tobytes())])
                yield from zip(own, _listed(cut), strict=True)


def encoder(path: str, specials_are_text: bool = True) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    key = (path, specials_are_text)
    if key not in _LOADED:
        _LOADED[key] = WordEncoder(path, specials_are_text)
    return _LOADED[key]


def _listed(values: pa.Array) -> list:
    """Strings or bytes as a list, which by ``to_pylist`` takes many times as long."""
    return values.to_numpy(zero_copy_only=False).tolist()


def text_slices(batch: pa.RecordBatch, column: int, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, each with about ``max_bytes`` of text in ``column``, a longer text alone at most."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(batch):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
