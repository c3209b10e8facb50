"""Secret scans: known forms by pattern, unknown ones by a battery of randomness tests."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import private, quoted, staged, table

#: kind: (pattern, group that holds the secret, least length of that group), in the order of reports. Fixed values.
KINDS = {
    "assign": (
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
}
RANDOM = "random"

#: Runs of the characters of common encodings, with their padding long enough for the tests to tell.
#: '=' is padding only where the run ends with it; in NAME=VALUE it parts two runs.
CANDIDATE = (
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_=-]{20})"
    r"(?:[A-Za-z0-9+/_-]{20,}+(?:=+(?![A-Za-z0-9+/_=-]))?|[A-Za-z0-9+/_-]++=+(?![A-Za-z0-9+/_=-]))"
)
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: encoding: (pattern of the whole candidate, alphabet in order, least chance that two characters
#: of a plain string are equal). The first that fits counts; plain numbers fit none. The chances are
#: those at which the p-values hold for words put together in the ways that names are.
ENCODINGS = {
    "hex": (r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef", 0.125),
    "base32": (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", _LOWER + "234567", 0.065),
    "base36": (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", _DIGITS + _LOWER, 0.06),
    "base64": (r"^(?=.*[A-Za-z])[A-Za-z0-9+/_-]+=*$", _LOWER.upper() + _LOWER + _DIGITS + "+/", 0.044),
}
#: Most changes of character class, for each pair of neighbours, in a plain string.
TEXT_CHANGES = 0.15
#: Least correlation between neighbours in a string that counts on or repeats.
TEXT_CORRELATION = 0.7
#: Evidence is kept in steps of 1 / STEPS nats, up to MOST_STEPS.
STEPS, MOST_STEPS = 16, 1024
#: Lengths at which a new stratum of candidates begins.
STRATA = (32, 64, 128)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _cut(text: Column, pattern: str, group: int) -> Column:
    """Matches of ``pattern`` and what lies between them; null without any.

    Spark tells no places of matches, but they follow from the lengths of these parts.
    """
    return F.when(
        text.rlike(pattern),
        F.struct(
            F.split(text, pattern, -1).alias("between"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"),
        ),
    )


def _placed(cut: Column, block: int = 512) -> Column:
    """The matches of :func:`_cut` as array of (start, end, value), in code points, end exclusive.

    Lengths are added up by blocks first, so that texts with very many matches stay cheap.
    """

    def spans(between: Column, matches: Column) -> Column:
        last = F.size(matches) - 1
        blocks = F.sequence(F.lit(0), F.floor(last / block).cast("int"))

        def in_block(k: Column, n: Column, m: Column) -> Column:
            return _total(F.slice(between, k * block + 1, n)) + _total(F.slice(matches, k * block + 1, m))

        def place(bases: Column, i: Column) -> Column:
            k = F.floor(i / block).cast("int")
            start = bases[k] + in_block(k, i % block + 1, i % block)
            return _let(
                start,
                lambda s: F.struct(s.alias("start"), (s + matches[i]).alias("end"), cut["values"][i].alias("value")),
            )

        sums = F.transform(blocks, lambda k: in_block(k, F.lit(block), F.lit(block)))
        return _let(
            sums,
            lambda s: _let(
                F.transform(blocks, lambda k: _total(F.slice(s, F.lit(1), k))),
                lambda bases: F.transform(F.sequence(F.lit(0), last), lambda i: place(bases, i)),
            ),
        )

    lengths = lambda parts: F.transform(parts, lambda x: F.char_length(x).cast("long"))
    return _let(lengths(cut["between"]), lambda b: _let(lengths(cut["matches"]), lambda m: spans(b, m)))


def _normal_nats(z: Column) -> Column:
    """-ln of the chance that a standard normal exceeds ``z``, from below; 0 for what is no excess.

    The chance is at most the density times 4 / (3 z + sqrt(z * z + 8)), and near that.
    """
    return _let(
        z,
        lambda x: F.when(x <= 0, 0.0).otherwise(
            x * x / 2 + math.log(math.sqrt(2 * math.pi)) - F.ln(4 / (3 * x + F.sqrt(x * x + 8)))
        ),
    )


def _uniformity(symbols: Column, plain: Column, letters: Column, chance: Column) -> Column:
    """Chi-squared test of the alphabet: -ln of the p-value under "two characters are equal as often as in plain strings".

    The statistic is Pearson's, of the counts of all ``letters`` against equal ones. Of a plain string
    it has a noncentral chi-squared distribution with letters - 1 degrees of freedom, whose
    noncentrality follows from ``chance``; a random string falls into its lower tail, which is
    taken by the normal distribution of the cube root (Abdel-Aty).
    """
    n = F.size(symbols).cast("double")
    times = F.transform(F.array_distinct(symbols), lambda x: n - F.length(F.replace(plain, x, F.lit(""))))
    squares = F.aggregate(times, F.lit(0.0), lambda a, x: a + x * x)
    free, away = letters - 1, (n - 1) * (letters * chance - 1)
    return _let(
        F.struct(
            (letters / n * squares - n).alias("statistic"),
            (free + away).alias("mean"),
            (2 * (1 + away / (free + away)) / (9 * (free + away))).alias("spread"),
        ),
        lambda s: _normal_nats(
            (1 - s["spread"] - F.pow(s["statistic"] / s["mean"], F.lit(1 / 3))) / F.sqrt(s["spread"])
        ),
    )


def _runs(symbols: Column) -> Column:
    """Runs test on character classes: -ln of the p-value under "neighbours are of different classes as seldom as in plain strings".

    Runs are changes plus one; the chance of so many is bounded by Chernoff's bound of a binomial.
    """
    kinds = F.transform(
        symbols,
        lambda x: F.when(x.between("0", "9"), 0).when(x.between("a", "z"), 1).when(x.between("A", "Z"), 2).otherwise(3),
    )
    n = F.size(symbols) - 1
    changes = _let(
        kinds,
        lambda k: _total(
            F.zip_with(F.slice(k, F.lit(1), n), F.slice(k, F.lit(2), n), lambda x, y: F.when(x == y, 0).otherwise(1))
        ),
    )
    p = TEXT_CHANGES
    return _let(
        changes / n,
        lambda s: n
        * F.when(s <= p, 0.0)
        .when(s >= 1, math.log(1 / p))
        .otherwise(s * F.ln(s / p) + (1 - s) * F.ln((1 - s) / (1 - p))),
    )


def _serial(symbols: Column, alphabet: Column) -> Column:
    """Serial correlation of ranks in the alphabet at lag 1: -ln of the p-value under "the string counts on or repeats".

    Fisher's z of the correlation is normal with variance 1 / (pairs - 3).
    """
    n = F.size(symbols) - 1
    ranks = F.transform(symbols, lambda x: F.instr(alphabet, x).cast("long"))

    def sums(r: Column) -> Column:
        x, y = F.slice(r, F.lit(1), n), F.slice(r, F.lit(2), n)
        product = lambda v, w: v * w
        return F.struct(
            _total(x).alias("x"),
            _total(y).alias("y"),
            _total(F.zip_with(x, x, product)).alias("xx"),
            _total(F.zip_with(y, y, product)).alias("yy"),
            _total(F.zip_with(x, y, product)).alias("xy"),
        )

    def moments(s: Column) -> Column:
        vx, vy = n * s["xx"] - s["x"] * s["x"], n * s["yy"] - s["y"] * s["y"]
        together = (n * s["xy"] - s["x"] * s["y"]).cast("double")
        return F.when((vx <= 0) | (vy <= 0), 1.0).otherwise(
            F.abs(together) / (F.sqrt(vx.cast("double")) * F.sqrt(vy.cast("double")))
        )

    z = math.atanh(TEXT_CORRELATION)
    return _let(
        _let(_let(ranks, sums), moments),
        lambda r: F.when(r >= TEXT_CORRELATION, 0.0).otherwise(
            _normal_nats((z - F.ln((1 + r) / (1 - r)) / 2) * F.sqrt((n - 3).cast("double")))
        ),
    )


def _first(column: Column, values: list) -> Column:
    """The value of the first encoding whose pattern fits ``column``; null if none does."""
    out = None
    for (pattern, _, _), value in zip(ENCODINGS.values(), values, strict=True):
        out = (F.when if out is None else out.when)(column.rlike(pattern), value)
    return out


def evidence(token: Column) -> Column:
    """Evidence in whole steps of 1 / STEPS nats that a candidate is random; 0 without an encoding.

    Each test has a hypothesis of its own on how a string is no secret, and evidence is -ln of its
    p-value. The candidate has to refute all of them, so the least evidence counts (the largest
    p-value, as for any union of hypotheses); all of it grows with length.
    """
    alphabet = _first(token, [F.lit(a) for _, a, _ in ENCODINGS.values()])
    chance = _first(token, [F.lit(x) for _, _, x in ENCODINGS.values()])
    plain = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    return _let(
        F.struct(alphabet.alias("abc"), chance.alias("chance"), plain.alias("plain")),
        lambda e: F.when(e["abc"].isNull() | (F.length(e["plain"]) < 8), 0).otherwise(
            _let(
                F.regexp_extract_all(e["plain"], F.lit("."), F.lit(0)),
                lambda c: F.least(
                    _uniformity(c, e["plain"], F.length(e["abc"]).cast("double"), e["chance"]),
                    _runs(c),
                    _serial(
                        F.when(F.length(e["abc"]) < 64, F.transform(c, lambda x: F.lower(x))).otherwise(c), e["abc"]
                    ),
                    F.lit(float(MOST_STEPS // STEPS)),
                ).cast("double")
                * STEPS,
            ).cast("int")
        ),
    )


def _stratum(length: Column) -> Column:
    return sum((F.when(length >= x, 1).otherwise(0) for x in STRATA), F.lit(0))


def _numbered(placed: str, kind: str, nth: int) -> Column:
    """Spans of a kind whose secret is long enough, with the kind's number."""
    long_enough = F.filter(placed, lambda s: F.char_length(s["value"]) >= KINDS[kind][2])
    return F.transform(
        long_enough, lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("kind"), s["end"].alias("end"))
    )


def with_candidates(docs: DataFrame, columns: list[str], into: str) -> DataFrame:
    """``columns`` of ``docs`` and a struct ``into`` of ``base``, spans of known forms, and ``free``, the candidates apart from them."""
    text = F.coalesce("text", F.lit(""))
    patterns = {kind: (pattern, group) for kind, (pattern, group, _) in KINDS.items()} | {RANDOM: (CANDIDATE, 0)}
    # names of ours, which no column of the documents has
    cuts = {kind: private(docs, f"cut_{kind}") for kind in patterns}
    placed = {kind: private(docs, f"in_{kind}") for kind in patterns}
    base = private(docs, "base")
    rows = docs.withColumns({cuts[kind]: _cut(text, *how) for kind, how in patterns.items()})
    rows = rows.withColumns({placed[kind]: F.when(F.col(cut).isNotNull(), _placed(F.col(cut))) for kind, cut in cuts.items()})
    none = F.expr("cast(array() AS array<struct<start: bigint, kind: int, end: bigint>>)")
    known = [F.coalesce(_numbered(placed[kind], kind, nth), none) for nth, kind in enumerate(KINDS)]
    free = F.filter(
        placed[RANDOM],
        lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    tested = F.transform(
        free,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.xxhash64(s["value"]).alias("token"),
            _stratum(F.char_length(s["value"])).alias("stratum"),
            evidence(s["value"]).alias("steps"),
        ),
    )
    found = F.struct(F.col(base).alias("base"), F.when(F.col(placed[RANDOM]).isNotNull(), tested).alias("free"))
    return rows.withColumn(base, F.array_sort(F.concat(*known))).select(*map(quoted, columns), found.alias(into))


def false_discovery_steps(candidates: DataFrame, rate: float) -> dict[int, int]:
    """Least evidence, in steps, at which a candidate of each stratum of lengths is a discovery.

    Benjamini and Hochberg's rule over the distinct candidates of the stratum. Evidence is counted
    in steps, so that one small histogram for each stratum says all; strata without discoveries are
    left out.
    """
    counts = candidates.dropDuplicates(["token"]).groupBy("stratum", "steps").agg(F.count(F.lit(1)).alias("n"))
    above = W.partitionBy("stratum").orderBy(F.desc("steps"))
    least = (
        counts.withColumn("found", F.sum("n").over(above))
        .withColumn("all", F.sum("n").over(W.partitionBy("stratum")))
        .filter(F.exp(-F.col("steps") / STEPS) <= rate * F.col("found") / F.col("all"))
        .groupBy("stratum")
        .agg(F.min("steps").alias("steps"))
    )
    return {r.stratum: r.steps for r in least.collect()}


def find_secrets(docs: DataFrame, rate: float = 0.01, columns: list[str] | None = None, into: str = "secrets") -> DataFrame:
    """``columns`` of ``docs`` (all by default) and their secrets, a struct ``into`` of ``base`` and ``spans``, arrays of (start, kind, end).

    ``base`` has the matches of KINDS, numbered in that order; ``spans`` adds, as the next number,
    candidates that look random: runs of at least 20 characters of an encoding, apart from base
    spans, whose evidence from all randomness tests passes the false-discovery threshold ``rate``
    of their stratum of lengths over the whole corpus. Places are code points, end exclusive; both
    arrays are sorted by start, then kind.

    All of it is DataFrame expressions: one pass over the texts writes base spans and candidates
    with ``columns``; the histogram of evidence, which is of fixed size, and the report are made from
    what it wrote. Nothing is shuffled but distinct candidates. Null texts count as empty; texts of any
    length are searched whole; ids play no part, so null and repeated ones are fine; columns of any
    other name stay as they are, but ``into`` must be new; an empty table stays so.
    """
    columns = docs.columns if columns is None else columns
    if into.lower() in {c.lower() for c in columns}:
        raise ValueError(f"there is a column {into} already")
    scanned = staged(with_candidates(docs, columns, into), "secrets-candidates")
    steps = false_discovery_steps(scanned.select(F.inline(f"{into}.free")), rate)
    found = F.filter(
        f"{into}.free",
        lambda s: F.coalesce(
            *[F.when(s["stratum"] == stratum, s["steps"] >= least) for stratum, least in steps.items()], F.lit(False)
        ),
    )
    added = F.transform(
        found,
        lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")),
    )
    none = F.expr("cast(array() AS array<struct<start: bigint, kind: int, end: bigint>>)")
    base = F.col(f"{into}.base")
    spans = F.array_sort(F.concat(base, F.coalesce(added, none)))
    return scanned.select(*map(quoted, columns), F.struct(base.alias("base"), spans.alias("spans")).alias(into))


def spans_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in [*KINDS, RANDOM]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with ``mark`` in place of each span; overlapping spans share one mark."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("done"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["done"]
        kept = F.substring(text, (a["done"] + 1).cast("int"), (s["start"] - a["done"]).cast("int"))
        return F.struct(
            F.when(fresh, F.concat(a["out"], kept, F.lit(mark))).otherwise(a["out"]).alias("out"),
            F.greatest(a["done"], s["end"]).alias("done"),
        )

    return F.when(F.size(spans) == 0, text).otherwise(
        F.aggregate(
            spans, state, step, lambda a: F.concat(a["out"], F.substring(text, (a["done"] + 1).cast("int"), F.length(text)))
        )
    )


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find the secrets in every text of ``documents``."""
    found = find_secrets(table(spark, sf_dir, "documents"), columns=["doc_id"])
    base, spans = F.col("secrets.base"), F.col("secrets.spans")
    count = lambda nth: F.size(F.filter(base, lambda s: s["kind"] == nth)).cast("long")
    return found.select(
        "doc_id",
        *[count(nth).alias(f"n_{kind}") for nth, kind in enumerate(KINDS)],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
    )


def _cut_sql(nth: int, kind: str, pattern: str, group: int, least: int, test: str | None = None) -> str:
    quoted, test = pattern.replace("'", "''"), (test or pattern).replace("'", "''")
    return f"""
    SELECT row_id, {nth} AS nth, '{kind}' AS kind, {least} AS least, regexp_split_to_array(text, '{quoted}') AS between,
           regexp_extract_all(text, '{quoted}', 0) AS matches, regexp_extract_all(text, '{quoted}', {group}) AS secrets
    FROM docs WHERE regexp_matches(text, '{test}')"""


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


#: The patterns without what RE2 doesn't know.
_SQL_CUTS = " UNION ALL ".join(
    [
        _cut_sql(0, "assign", KINDS["assign"][0].replace("?i:password|passwd|secret|token|api_?key", "?:" + _either_case("password|passwd|secret|token|api_?key")), 1, 6),
        _cut_sql(1, "access", KINDS["access"][0], 0, 20),
        _cut_sql(2, "hex", "[0-9a-f]{24,}", 0, 24),
        _cut_sql(3, RANDOM, "[A-Za-z0-9+/_-]+=*", 0, 20, "[A-Za-z0-9+/_=-]{20}"),
    ]
)

OP1_SQL = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), cuts AS ({_SQL_CUTS}
), spans AS (
    SELECT row_id, nth, kind, least, value, secret, begins, begins + length(value) AS ends FROM (
        -- '=' between two runs belongs to neither
        SELECT row_id, nth, kind, least,
               CASE WHEN nth = 3 AND i < len(matches) AND between[i + 1] = '' THEN rtrim(matches[i], '=') ELSE matches[i] END AS value,
               CASE WHEN nth = 3 AND i < len(matches) AND between[i + 1] = '' THEN rtrim(matches[i], '=') ELSE secrets[i] END AS secret,
               CAST(list_sum(list_transform(between[1:i], lambda x: length(x)))
                    + coalesce(list_sum(list_transform(matches[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS begins
        FROM (SELECT *, unnest(list_filter(range(1, len(matches) + 1), lambda i: length(secrets[i]) >= least)) AS i FROM cuts)
    ) WHERE length(secret) >= least
), base AS (
    SELECT * FROM spans WHERE nth < 3
), free AS (
    SELECT * FROM spans s WHERE nth = 3
      AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row_id = s.row_id AND b.begins < s.ends AND s.begins < b.ends)
), tokens AS (
    SELECT *, CASE encoding WHEN 'hex' THEN 0.125::DOUBLE WHEN 'base32' THEN 0.065::DOUBLE WHEN 'base36' THEN 0.06::DOUBLE
                            WHEN 'base64' THEN 0.044::DOUBLE END AS chance,
           CASE encoding WHEN 'hex' THEN '{ENCODINGS['hex'][1]}' WHEN 'base32' THEN '{ENCODINGS['base32'][1]}'
                         WHEN 'base36' THEN '{ENCODINGS['base36'][1]}' WHEN 'base64' THEN '{ENCODINGS['base64'][1]}' END AS abc,
           translate(regexp_replace(value, '=+$', ''), '-_', '+/') AS plain
    FROM (SELECT DISTINCT value, CASE
            WHEN regexp_matches(value, '^([0-9a-f]+|[0-9A-F]+)$') AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-fA-F]') THEN 'hex'
            WHEN regexp_matches(value, '^[A-Z2-7]+=*$') AND regexp_matches(value, '[2-7]') AND regexp_matches(value, '[A-Z]') THEN 'base32'
            WHEN regexp_matches(value, '^[0-9a-z]+$') AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') THEN 'base36'
            WHEN regexp_matches(value, '^[A-Za-z0-9+/_-]+=*$') AND regexp_matches(value, '[A-Za-z]') THEN 'base64' END AS encoding
          FROM free)
), chars AS (
    SELECT value, i, substr(plain, i, 1) AS c, instr(abc, CASE WHEN length(abc) < 64 THEN lower(substr(plain, i, 1)) ELSE substr(plain, i, 1) END) AS r
    FROM (SELECT *, unnest(range(1, length(plain) + 1)) AS i FROM tokens WHERE encoding IS NOT NULL AND length(plain) >= 8)
), pairs AS (
    SELECT value, sum(n * n)::DOUBLE AS squares FROM (SELECT value, c, count(*) AS n FROM chars GROUP BY ALL) GROUP BY value
), steps_of AS (
    SELECT value, r AS y, lag(r) OVER o AS x, CASE WHEN kind <> lag(kind) OVER o THEN 1 ELSE 0 END AS changed
    FROM (SELECT *, CASE WHEN c BETWEEN '0' AND '9' THEN 0 WHEN c BETWEEN 'a' AND 'z' THEN 1 WHEN c BETWEEN 'A' AND 'Z' THEN 2 ELSE 3 END AS kind FROM chars)
    WINDOW o AS (PARTITION BY value ORDER BY i)
), moments AS (
    SELECT value, count(*) AS n, sum(changed) / count(*)::DOUBLE AS share,
           count(*) * sum(x * x) - sum(x) * sum(x) AS vx, count(*) * sum(y * y) - sum(y) * sum(y) AS vy,
           count(*) * sum(x * y) - sum(x) * sum(y) AS xy
    FROM steps_of WHERE x IS NOT NULL GROUP BY value
), measured AS (
    SELECT value, n, share, squares, (n + 1)::DOUBLE AS size, length(abc)::DOUBLE AS letters, chance,
           CASE WHEN vx <= 0 OR vy <= 0 THEN 1.0::DOUBLE ELSE abs(xy::DOUBLE) / (sqrt(vx::DOUBLE) * sqrt(vy::DOUBLE)) END AS rho
    FROM moments JOIN pairs USING (value) JOIN tokens USING (value)
), shaped AS (
    SELECT *, letters / size * squares - size AS statistic, letters - 1 + away AS mean,
           2 * (1 + away / (letters - 1 + away)) / (9 * (letters - 1 + away)) AS spread
    FROM (SELECT *, (size - 1) * (letters * chance - 1) AS away FROM measured)
), scored AS (
    SELECT *, (1 - spread - pow(statistic / mean, {1 / 3!r}::DOUBLE)) / sqrt(spread) AS z1,
           CASE WHEN rho >= 0.7::DOUBLE THEN 0 ELSE ({math.atanh(TEXT_CORRELATION)!r}::DOUBLE - ln((1 + rho) / (1 - rho)) / 2) * sqrt((n - 3)::DOUBLE) END AS z3
    FROM shaped
), judged AS (
    SELECT value, CAST(trunc(16 * least(
        CASE WHEN z1 <= 0 THEN 0 ELSE z1 * z1 / 2 + {math.log(math.sqrt(2 * math.pi))!r}::DOUBLE - ln(4 / (3 * z1 + sqrt(z1 * z1 + 8))) END,
        n * CASE WHEN share <= 0.15::DOUBLE THEN 0 WHEN share >= 1 THEN ln(1 / 0.15::DOUBLE)
                 ELSE share * ln(share / 0.15::DOUBLE) + (1 - share) * ln((1 - share) / 0.85::DOUBLE) END,
        CASE WHEN z3 <= 0 THEN 0 ELSE z3 * z3 / 2 + {math.log(math.sqrt(2 * math.pi))!r}::DOUBLE - ln(4 / (3 * z3 + sqrt(z3 * z3 + 8))) END,
        64.0::DOUBLE)) AS INTEGER) AS steps
    FROM scored
), candidates AS (
    SELECT t.value, coalesce(j.steps, 0) AS steps,
           (length(t.value) >= 32)::INT + (length(t.value) >= 64)::INT + (length(t.value) >= 128)::INT AS stratum
    FROM tokens t LEFT JOIN judged j USING (value)
), least_steps AS (
    SELECT stratum, min(steps) AS bar FROM (
        SELECT stratum, steps, sum(n) OVER (PARTITION BY stratum ORDER BY steps DESC) AS found, sum(n) OVER (PARTITION BY stratum) AS everything
        FROM (SELECT stratum, steps, count(*) AS n FROM candidates GROUP BY ALL)
    ) WHERE exp(-steps / 16.0::DOUBLE) <= 0.01::DOUBLE * found / everything GROUP BY stratum
), reported AS (
    SELECT row_id, nth, kind, begins, ends FROM base
    UNION ALL
    SELECT row_id, nth, kind, begins, ends FROM free JOIN candidates USING (value) JOIN least_steps USING (stratum) WHERE steps >= bar
), joined AS (
    SELECT row_id, count(*) FILTER (WHERE nth = 0) AS n_assign, count(*) FILTER (WHERE nth = 1) AS n_access,
           count(*) FILTER (WHERE nth = 2) AS n_hex,
           string_agg(kind || ':' || begins || ':' || ends, ',' ORDER BY begins, nth) FILTER (WHERE nth < 3) AS base,
           string_agg(kind || ':' || begins || ':' || ends, ',' ORDER BY begins, nth) AS spans
    FROM reported GROUP BY row_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN joined j USING (row_id)
"""
