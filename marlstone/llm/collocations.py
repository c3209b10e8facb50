"""Phrase collocations by Toivonen's mining: a sample proposes phrases and their border, full passes count them exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, quoted, sized, staged, table
from marlstone.llm.tokens import text_slices

#: A-Z as a-z, a tab as a blank, and everything that ends a piece as a full stop, which no word holds.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 46 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
#: Bytes of text that are split at once; words kept by a task, whose numbers take ``BITS``; n-grams kept before they are sent on.
STRETCH, MOST_WORDS, BITS, MOST_GRAMS = 2_000_000, 600_000, 21, 3_000_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
#: Bits of a filter at least and at most: 16 MB, whatever is put in.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
_COUNTS = "lang string, words int, phrase binary, n long"


def stretches(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in order, a full stop between pieces; cut at blanks so that no list is long."""
    flat, start = text.translate(_TO_WORDS), 0
    while start < len(flat):
        end = flat.find(b" ", start + STRETCH) if len(flat) > start + STRETCH else -1
        end = len(flat) if end < 0 else end
        yield flat[start:end].replace(b".", b" . ").split()
        start = end


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of words from those of the words."""
    out = (first * _MIX[0]) ^ (second + (first >> np.uint64(31)))
    out = (out ^ (out >> np.uint64(29))) * _MIX[1]
    return out ^ (out >> np.uint64(32))


def hashed(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


@dataclass(frozen=True)
class Filter:
    """A Bloom filter of phrases by hash, two bits each.

    Its size is bounded whatever it holds. What it lets through beyond that is counted for nothing,
    but exactly; what it holds it never misses.
    """

    bits: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        size = np.uint64(len(self.bits) * 8 - 1)
        found = np.ones(len(hashes), dtype=bool)
        for at in (hashes & size, (hashes >> np.uint64(32)) & size):
            found &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found


def _phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """Hashes of the phrases (columns lang, phrase), of one or two words each."""
    out = np.zeros(len(batch), dtype=np.uint64)
    langs, phrases = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
    for lang in set(langs):
        own = np.flatnonzero(langs == lang)
        parts = [phrases[i].split(b" ") for i in own.tolist()]
        out[own] = hashed(lang, [p[0] for p in parts])
        pairs = np.array([len(p) == 2 for p in parts])
        out[own[pairs]] = joined(out[own[pairs]], hashed(lang, [p[1] for p in parts if len(p) == 2]))
    return out


def _set_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held = np.zeros(bits // 8, dtype=np.uint8)
    for batch in batches:
        hashes = _phrase_hashes(batch)
        for at in (hashes & np.uint64(bits - 1), (hashes >> np.uint64(32)) & np.uint64(bits - 1)):
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
    words = held.view("<i8")
    used = np.flatnonzero(words)
    for at in range(0, len(used), 100_000):
        own = used[at : at + 100_000]
        yield pa.record_batch([pa.array(own, pa.int32()), pa.array(words[own], pa.int64())], names=["place", "bits"])


def filter_of(phrases: DataFrame) -> Filter:
    """The filter of all ``phrases`` (lang, phrase), put together from those of tasks; what reaches the driver is bounded."""
    wanted, bits = 16 * phrases.count(), LEAST_BITS
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    found = phrases.select("lang", "phrase").mapInArrow(partial(_set_bits, bits=bits), "place int, bits long")
    words = np.zeros(bits // 64, dtype="<i8")
    for r in found.groupBy("place").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        words[r.place] = r.bits
    return Filter(words.view(np.uint8))


@dataclass(frozen=True)
class Wanted:
    """What a pass counts: all words, if ``all_words``; pairs of ``words``, one of them at least of ``new_words``; and triples
    whose two pairs are of ``pairs``, one of them at least of ``new_pairs``. None for words or pairs: none; for new ones: any."""

    all_words: bool
    words: Filter | None = None
    new_words: Filter | None = None
    pairs: Filter | None = None
    new_pairs: Filter | None = None
    every_pair: bool = False


class _Counter:
    """Counts of one language in one task, by numbers that words have here."""

    def __init__(self, lang: str, wanted: Wanted):
        self.lang, self.wanted = lang, wanted
        self.forget()

    def forget(self) -> None:
        self.names: list[bytes] = [b"."]
        self.number: dict[bytes, int] = {b".": 0}
        self.hashes = np.zeros(1, dtype=np.uint64)
        self.in_words, self.in_new = np.zeros(1, dtype=bool), np.zeros(1, dtype=bool)
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {1: [], 2: [], 3: []}
        self.size = 0

    def numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.number
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            known.update(zip(fresh, range(len(self.names), len(self.names) + len(fresh)), strict=True))
            self.names += fresh
            own = hashed(self.lang, fresh)
            want = self.wanted
            inside = want.words.has(own) if want.words else np.full(len(own), want.every_pair)
            self.hashes = np.concatenate([self.hashes, own])
            self.in_words = np.concatenate([self.in_words, inside])
            self.in_new = np.concatenate([self.in_new, want.new_words.has(own) if want.new_words else inside])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def add(self, ids: np.ndarray, before: int) -> None:
        """Count n-grams of ``ids`` that don't end in the first ``before``, which have been counted as ends."""
        want = self.wanted
        if want.all_words:
            self._keep(1, ids[before:][ids[before:] > 0])
        if len(ids) < 2 or not (want.words or want.every_pair or want.pairs):
            return
        a, b = ids[:-1], ids[1:]
        whole = (a > 0) & (b > 0)
        if want.words or want.every_pair:
            counted = whole & self.in_words[a] & self.in_words[b]
            if want.new_words:
                counted &= self.in_new[a] | self.in_new[b]
            counted[: max(0, before - 1)] = False
            self._keep(2, (a[counted] << BITS) | b[counted])
        if want.pairs and len(ids) > 2:
            at = np.flatnonzero(whole)
            hashes = joined(self.hashes[a[at]], self.hashes[b[at]])
            inside, new = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=bool)
            inside[at] = want.pairs.has(hashes)
            if want.new_pairs:
                new[at] = want.new_pairs.has(hashes)
            counted = inside[:-1] & inside[1:]
            if want.new_pairs:
                counted &= new[:-1] | new[1:]
            counted[: max(0, before - 2)] = False
            self._keep(3, (ids[:-2][counted] << (2 * BITS)) | (b[:-1][counted] << BITS) | ids[2:][counted])

    def _keep(self, words: int, keys: np.ndarray) -> None:
        if len(keys):
            self.held[words].append(np.unique(keys, return_counts=True))
            self.size += len(self.held[words][-1][0])

    def shrink(self) -> bool:
        """Merge equal n-grams; whether what is left is so much that it should be sent on."""
        self.size = 0
        for words, parts in self.held.items():
            if parts:
                keys, owner = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                self.held[words] = [(keys, np.bincount(owner, np.concatenate([n for _, n in parts])).astype(np.int64))]
                self.size += len(keys)
        return 3 * self.size > 2 * MOST_GRAMS

    def sent(self) -> Iterator[pa.RecordBatch]:
        """All counts as rows, and a fresh start."""
        self.shrink()
        names, mask = pa.array(self.names, pa.binary()), (1 << BITS) - 1
        for words, parts in self.held.items():
            for keys, counts in parts:
                for at in range(0, len(keys), 50_000):
                    own, n = keys[at : at + 50_000], counts[at : at + 50_000]
                    spelt = [names.take(pa.array((own >> (BITS * k)) & mask)) for k in reversed(range(words))]
                    phrase = spelt[0] if words == 1 else pc.binary_join_element_wise(*spelt, pa.scalar(b" ", pa.binary()))
                    kind = [pa.array([self.lang] * len(own)), pa.array([words] * len(own), pa.int32()), phrase, pa.array(n)]
                    yield pa.record_batch(kind, names=["lang", "words", "phrase", "n"])
        self.forget()


def _count(batches: Iterator[pa.RecordBatch], wanted: Wanted | Broadcast) -> Iterator[pa.RecordBatch]:
    wanted = wanted if isinstance(wanted, Wanted) else wanted.value
    counters: dict[str, _Counter] = {}
    for batch in batches:
        for part in text_slices(batch, 1):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                counter = counters.setdefault(lang, _Counter(lang, wanted))
                before = np.zeros(0, dtype=np.int64)
                for words in stretches(b"\n".join(texts)):
                    ids = counter.numbers(words)
                    counter.add(np.concatenate([before, ids]), len(before))
                    before = np.concatenate([before, ids])[-2:]
                    if len(counter.names) > MOST_WORDS or counter.size > MOST_GRAMS and counter.shrink():
                        last = [counter.names[i] for i in before.tolist()]
                        yield from counter.sent()
                        before = counter.numbers(last)
            if len(counters) > 64 or sum(c.size for c in counters.values()) > 2 * MOST_GRAMS:
                for counter in counters.values():
                    yield from counter.sent()
                counters.clear()
    for counter in counters.values():
        yield from counter.sent()


def _summed(rows: DataFrame) -> DataFrame:
    """Counts of tasks added up. They are distinct there already, so they are shuffled first: adding up before would find nothing."""
    return rows.repartition("lang", "phrase").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def _counted(texts: DataFrame, wanted: Wanted, least: int, name: str) -> DataFrame:
    """Exact counts of what is ``wanted``, of ``least`` at least, words of any; counted in tasks first."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)
    rows = _summed(texts.mapInArrow(partial(_count, wanted=shared), _COUNTS))
    return staged(rows.filter(f"n >= {least} OR words = 1 AND {wanted.all_words}"), name)


def _missed(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(~shared.value.has(_phrase_hashes(batch))))


def _beyond(phrases: DataFrame, held: Filter, name: str) -> DataFrame:
    """The ``phrases`` that a filter does not hold."""
    shared = phrases.sparkSession.sparkContext.broadcast(held)
    return staged(phrases.select("lang", "phrase").mapInArrow(partial(_missed, shared=shared), "lang string, phrase binary"), name)


def mine(texts: DataFrame, least: int = 10, share: float = 0.25, lowered: float = 0.8) -> DataFrame:
    """Counts of all words, and of all phrases of 2 and 3 words that occur ``least`` times, by language: (lang, words, phrase, n).

    ``texts`` has (lang, text, point): not null, and a number from 0 to 1 that draws the sample. Phrases
    frequent in a sample of ``share`` (at ``lowered`` * ``share`` * ``least``) are proposed. The first full
    pass counts these and their negative border: all words, all pairs of proposed words and all
    triples of two proposed pairs. Where words or pairs of the border turn out frequent, further
    passes count what those make possible, until nothing new is frequent; so the result is exact,
    whatever the sample was. Sets of phrases reach the tasks as filters of bounded size.
    """
    at_least = max(1, int(least * share * lowered))
    drawn = texts.filter(F.col("point") < share).mapInArrow(partial(_count, wanted=Wanted(True, every_pair=True)), _COUNTS)
    sample = staged(_summed(drawn).filter(f"n >= {at_least}"), "phrases-sample")
    of = lambda rows, words: rows.filter(F.col("words") == words)
    proposed_words, proposed_pairs = filter_of(of(sample, 1)), filter_of(of(sample, 2))
    passes = [_counted(texts, Wanted(True, words=proposed_words, pairs=proposed_pairs), least, "phrases")]
    words = of(passes[0], 1).filter(f"n >= {least}")
    new_words = _beyond(words, proposed_words, "phrases-words")
    new_pairs = _beyond(of(passes[0], 2), proposed_pairs, "phrases-pairs")
    pairs = of(passes[0], 2).select("lang", "phrase")
    for number in range(2):
        wanted = {}
        if number == 0 and not new_words.isEmpty():
            wanted |= {"words": filter_of(words), "new_words": filter_of(new_words)}
        if not new_pairs.isEmpty():
            wanted |= {"pairs": filter_of(pairs), "new_pairs": filter_of(new_pairs)}
        if not wanted:
            break
        passes.append(_counted(texts, Wanted(False, **wanted), least, "phrases"))
        # pairs of new words are frequent for the first time: the triples that hold them are not counted yet
        new_pairs = of(passes[-1], 2).select("lang", "phrase")
        pairs = pairs.unionByName(new_pairs)
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    # what a filter let through twice has been counted twice, each time in full
    return found.groupBy("lang", "words", "phrase").agg(F.max("n").alias("n")) if len(passes) > 1 else found


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, most: int = 2_000, inside: int = 50) -> DataFrame:
    """The ``most`` best phrases of every language: (lang, rank, phrase, a, l, r, n, score).

    A phrase of 2 or 3 words that occurs ``a`` >= ``least`` times within pieces has for each cut the score
    floor(1000000 * a * a / (l * r)); the lowest counts, at the smallest cut. Phrases within a longer
    one that occurs in ``inside`` % of their places are left out. Null texts are empty, a null language
    is `und`; texts of any length are counted whole, in stretches; repeated rows count as often as
    they occur. An empty table has no phrases; columns of other names play no part.
    """
    name, body = quoted(lang), F.col(quoted(text))
    rows = docs.select(F.coalesce(F.col(name).cast("string"), F.lit("und")).alias("lang"), body.cast("binary").alias("text"), _point(docs, body).alias("point"))
    counts = mine(bounded_batches(rows.filter("text IS NOT NULL")), least)
    counts = staged(counts, "phrases-counts")
    totals = counts.filter("words = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = counts.filter(f"n >= {least}")
    part = sized(staged(frequent.filter("words < 3").select("lang", F.col("phrase").alias("part"), F.col("n").alias("part_n")), "phrases-parts"))
    text_of = frequent.filter("words > 1").select("lang", "words", F.col("phrase").cast("string").alias("phrase"), F.col("n").alias("a"))
    word = F.split("phrase", " ")
    spelt = lambda first, count: F.array_join(F.slice(word, first, count), " ").cast("binary")
    cuts = text_of.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", spelt(1, F.col("k"))).withColumn("rest", spelt(F.col("k") + 1, F.col("words") - F.col("k")))
    for side, count in (("first", "l"), ("rest", "r")):
        own = part.withColumnsRenamed({"part": side, "part_n": count})
        cuts = cuts.join(own, ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"aa": wide("a") * wide("a"), "lr": wide("l") * wide("r")})
    cuts = cuts.withColumn("score", F.expr("CAST(1000000 * CAST(aa AS DECIMAL(31,0)) DIV lr AS BIGINT)"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "words", "phrase", "a").agg(lowest)
    longer = text_of.filter("words = 3").select("lang", F.col("a").alias("longer"), F.explode(F.array(
        F.array_join(F.slice(word, 1, 2), " "), F.array_join(F.slice(word, 2, 2), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    scored = scored.join(longer, ["lang", "phrase"], "left").filter(f"longer IS NULL OR 100 * longer < {inside} * a")
    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    best = best.join(F.broadcast(totals), "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _point(docs: DataFrame, body) -> F.Column:
    """Draws documents for the sample by their id, if there is one, and text."""
    keys = [F.col("doc_id")] if "doc_id" in docs.columns else []
    return F.pmod(F.xxhash64(*keys, body, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of each language of ``documents``."""
    return collocations(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


OP12_SQL = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS piece, lang, words FROM (
        SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS words FROM (
            SELECT coalesce(lang, 'und') AS lang,
                   regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]') AS pieces
            FROM documents WHERE text IS NOT NULL))
), placed AS (
    SELECT piece, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM pieces
), followed AS (
    SELECT lang, w, lead(w, 1) OVER places AS w2, lead(w, 2) OVER places AS w3
    FROM placed WINDOW places AS (PARTITION BY piece ORDER BY i)
), grams AS (
    SELECT lang, 1 AS k, w AS phrase, count(*) AS f FROM followed GROUP BY ALL
    UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) FROM followed WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM followed WHERE w3 IS NOT NULL GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS words FROM grams WHERE k > 1 AND f >= 10
), cuts AS (
    SELECT c.lang, c.size, c.phrase, c.a, cut.k, l.f AS l, r.f AS r,
           CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
    FROM candidates c JOIN (VALUES (1), (2)) AS cut(k) ON cut.k < c.size
    JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:cut.k], ' ')
    JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[cut.k + 1:c.size], ' ')
), lowest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts
), longer AS (
    SELECT lang, unnest([words[1] || ' ' || words[2], words[2] || ' ' || words[3]]) AS phrase, a FROM candidates WHERE size = 3
), longest AS (
    SELECT lang, phrase, max(a) AS longer FROM longer GROUP BY lang, phrase
), kept AS (
    SELECT lowest.* FROM lowest LEFT JOIN longest USING (lang, phrase)
    WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 50 * a)
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
