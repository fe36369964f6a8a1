"""Secret scans with a battery of randomness tests. DataFrame operations only.

Base patterns find assignments, access keys and long hexadecimal runs. The method adds spans: runs of encoding
characters whose encoding (hexadecimal, base 32, base 64) is inferred from their letters and which

* pass three tests of randomness (chi-squared uniformity over the encoding's alphabet, runs over its halves, serial
  correlation of neighbouring symbols): the sum T of their squared deviations, of which only an uneven alphabet counts in
  the first, stays under the 99.9 % point of chi-squared with three degrees, and
* are discoveries: ordinary text hardly reaches so small a T. In text of n letters, which coincide as in prose, the first
  deviation alone is normal about a mean that grows with n, and T is at least its square, so the chance of a T as small in
  text is bounded by that normal distribution at the root of T. These p-values of the battery go through
  Benjamini-Hochberg steps over all candidates of the corpus, in strata of equal length, since short strings can't be
  told from text with any confidence.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log10

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import cut

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Where any assignment has to have a colon or an equals sign, this is the cheap test that most texts fail.
MAY_ASSIGN = r"(?i)(?:passw|secret|token|api_?key)"
#: A run of 16 characters or more that starts with AKIA, and one of 32 hexadecimal digits: a shorter run matches nothing
#: from any of its later starts either, so the length can be part of the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
HEXDIGITS, BASE32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What the symbols of any encoding are renamed to, so that the first is number 1 and has the code point 48.
CODES = "".join(map(chr, range(48, 112)))
#: Chance that two letters coincide in text written with the alphabet, by its size.
COINCIDENCE = {16: 0.1, 32: 0.066, 64: 0.066}
#: The 99.9 % point of chi-squared with three degrees, the false-discovery rate, bins of a tenth of log10 p, their number.
ACCEPT, RATE, STEP, BINS = 16.266, 0.01, 10, 400
#: Entries whose sizes are summed at once, and characters of a candidate that are taken apart at once.
CHUNK, SEGMENT = 32, 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let_all(values: list[Column], body: Callable[..., Column]) -> Column:
    """body(*values) with each value computed once; they may not use each other."""
    return let(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]), lambda x: body(*[x[f"v{i}"] for i in range(len(values))]))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def prefix_sums(sizes: Column, levels: int = 3) -> Column:
    """For each entry the sum of those before it: the sum before its chunk, found for the chunks' sums in the same way, and
    that of its chunk up to it. About CHUNK / 2 additions an entry; n / CHUNK^2 sums are added up directly."""
    if levels == 1:
        return F.transform(sizes, lambda _, i: _sum(F.slice(sizes, F.lit(1), i)))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda c: _sum(F.slice(sizes, c * CHUNK + 1, F.lit(CHUNK))))

    def at(before: Column) -> Column:
        return F.transform(sizes, lambda _, i: F.element_at(before, (F.floor(i / CHUNK) + 1).cast("int")) + _sum(F.slice(sizes, (i - i % CHUNK + 1).cast("int"), (i % CHUNK).cast("int"))))

    return F.when(F.size(sizes) > 0, let(chunks, lambda c: let(prefix_sums(c, levels - 1), at))).otherwise(F.array().cast("array<bigint>"))


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches, in code points, end exclusive."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))

    def located(found: Column) -> Column:
        def spans(sizes: Column) -> Column:
            return let(prefix_sums(sizes), lambda before: F.transform(found, lambda m, i: let(F.element_at(before, (2 * i + 2).cast("int")), lambda s: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))))

        # gap, match, gap, match ...: a match starts after all entries before it
        return let(F.flatten(F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.array(g, F.length(m).cast("long")))), spans)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
TOKEN = "array<struct<start:bigint,end:bigint,match:string>>"


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Spans of the base patterns, unsorted. A cheap test goes before each pattern."""
    none = F.array().cast(SPAN)
    value = lambda m: F.regexp_extract(m["match"], ASSIGN, 2)
    assign = F.when(text.rlike(MAY_ASSIGN), _spans(F.filter(occurrences(text, ASSIGN), lambda m: F.length(value(m)) >= 8), 0)).otherwise(none)
    access = F.when(text.contains("AKIA"), _spans(occurrences(text, ACCESS), 1)).otherwise(none)
    hexes = F.when(text.rlike(HEX), _spans(occurrences(text, HEX), 2)).otherwise(none)
    return F.concat(assign, access, hexes)


def _count(x: Column, part: str | Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(part) if isinstance(part, str) else part, F.lit("")))).cast("long")


def _by_size(k: Column, of: Callable[[str], Column]) -> Column:
    return F.when(k == 16, of(HEXDIGITS)).when(k == 32, of(BASE32)).otherwise(of(SYMBOLS))


def neighbours(coded: Column) -> Column:
    """Sum of the products of neighbouring symbols' numbers. Characters are taken apart a segment at a time, by byte
    offsets, so that the work is linear and a long candidate never becomes an array of its characters."""
    raw = coded.cast("binary")

    def segment(i: Column) -> Column:
        part = F.substring(raw, i * SEGMENT + 1, F.lit(SEGMENT + 1)).cast("string")
        values = F.transform(F.split(part, "", -1), lambda c: (F.ascii(c) - 47).cast("long"))
        return let(values, lambda v: _sum(F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda x, y: x * y)))

    last = F.greatest(F.floor((F.octet_length(coded) - 2) / SEGMENT), F.lit(0)).cast("int")
    return F.when(F.octet_length(coded) > 1, _sum(F.transform(F.sequence(F.lit(0), last), segment))).otherwise(F.lit(0).cast("long"))


def battery(token: Column) -> Column:
    """struct<stratum, bin, random>: the tests' results for one candidate, without padding. Every statistic comes from
    counts of symbols, of changes between halves, and one sum over neighbours; each is computed once."""
    plain = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")

    def inferred(p: Column) -> Column:
        is_hex = p.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        size = F.when(is_hex, 16).when(p.rlike("^[A-Z2-7]+$"), 32).otherwise(64)
        return let_all([F.when(is_hex, F.lower(p)).otherwise(p), size], lambda s, k: let(_by_size(k, lambda a: F.translate(s, a, CODES[: len(a)])), lambda coded: tests(coded, k)))

    def tests(coded: Column, k: Column) -> Column:
        counts = F.transform(F.slice(F.array(*map(F.lit, CODES)), F.lit(1), k), lambda c: _count(coded, c))
        halves = _by_size(k, lambda a: F.translate(coded, CODES[: len(a)], "0" * (len(a) // 2) + "1" * (len(a) // 2)))
        ones_and_changes = let(halves, lambda h: F.struct(_count(h, "1").alias("ones"), (F.floor(_count(h, "01") / 2) + F.floor(_count(h, "10") / 2)).alias("changes")))
        ends = [(F.ascii(F.substring(coded, at, 1)) - 47).cast("long") for at in (1, -1)]
        found = [F.greatest(F.length(coded), F.lit(2)).cast("double"), counts, ones_and_changes, neighbours(coded), *ends]
        return let_all(found, lambda n, counts, h, s12, first, last: sums(k.cast("double"), n, counts, h["ones"], h["changes"], s12, first, last))

    def sums(k: Column, n: Column, counts: Column, ones: Column, changes: Column, s12: Column, first: Column, last: Column) -> Column:
        squares = _sum(F.transform(counts, lambda c: c * c))
        s1, s2 = _sum(F.transform(counts, lambda c, i: c * (i + 1))), _sum(F.transform(counts, lambda c, i: c * (i + 1) * (i + 1)))
        return let_all([squares, s1, s2], lambda squares, s1, s2: deviations(k, n, squares, ones, changes, s1, s2, s12, first, last))

    def deviations(k: Column, n: Column, squares: Column, ones: Column, changes: Column, s1: Column, s2: Column, s12: Column, first: Column, last: Column) -> Column:
        spread = F.sqrt(2 * (k - 1) * (n - 1) / n)  # of chi-squared in random strings
        even = F.greatest((k / n * squares - n - (k - 1)) / spread, F.lit(0.0))
        expected = 2 * ones * (n - ones) / n + 1
        runs = let(expected, lambda mean: let((mean - 1) * (mean - 2) / (n - 1), lambda var: F.when(var > 0, (1 + changes - mean) / F.sqrt(var)).otherwise(99.0)))
        mean, around = s1 / n, lambda mean: s12 - mean * (2 * s1 - first - last) + (n - 1) * mean * mean
        serial = let(mean, lambda mean: let(s2 - n * mean * mean, lambda var: F.when(var > 1e-6, (around(mean) / var + 1 / (n - 1)) * F.sqrt(n)).otherwise(99.0)))
        excess = F.when(k == 16, 16 * COINCIDENCE[16] - 1).when(k == 32, 32 * COINCIDENCE[32] - 1).otherwise(64 * COINCIDENCE[64] - 1)
        return let_all([even, runs, serial, spread, (n - 1) * excess], lambda e, r, s, spread, more: let(e * e + r * r + s * s, lambda t: verdict(k, n, t, spread, more)))

    def verdict(k: Column, n: Column, t: Column, spread: Column, more: Column) -> Column:
        # in text chi-squared alone is about `more` larger, and the battery's root is no less than its deviation
        text_like = (more - F.sqrt(t) * spread) / F.sqrt(2 * (k - 1) + 4 * more)
        # the upper tail of the normal distribution, by Mills' ratio: an upper bound of p, as control asks for
        minus_log10 = let(text_like, lambda z: F.when(z > 1, z * z / 2 * log10(2.718281828459045) + F.log10(z) + 0.39909).otherwise(0.0))
        bin_ = F.least(F.floor(minus_log10 * STEP), F.lit(BINS - 1)).cast("int")
        return F.struct(F.floor(F.log2(n)).cast("int").alias("stratum"), bin_.alias("bin"), (t <= ACCEPT).alias("random"))

    return let(plain, inferred)


def thresholds(counts: list[tuple[int, int, int]]) -> dict[int, int]:
    """Benjamini-Hochberg for each stratum over (stratum, bin, count): the least bin that is a discovery."""
    out = {}
    for stratum in {s for s, _, _ in counts}:
        n = sorted(((b, c) for s, b, c in counts if s == stratum), reverse=True)
        total, seen = sum(c for _, c in n), 0
        for b, c in n:  # from the least p up
            seen += c
            if 10 ** (-b / STEP) <= RATE * seen / total:
                out[stratum] = b
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): spans array<struct<start, kind, end>>, kind a position in KINDS, sorted by start, then kind.

    One heavy narrow pass over whole texts writes spans and candidates' test results; counts of results by (length
    stratum, bin), of fixed size, give the thresholds; nothing else is shuffled. A null or empty text has no spans. Null
    keys and repeated rows come back each; candidates of repeated rows count each. An empty table gives an empty result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.when(t.rlike(CANDIDATE), F.transform(occurrences(t, CANDIDATE), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), battery(m["match"]).alias("r"))))
    rows = cut(docs.select(F.col(key), base_spans(t).alias("_base"), F.coalesce(found, F.array().cast("array<struct<start:bigint,end:bigint,r:struct<stratum:int,bin:int,random:boolean>>>")).alias("_found")))
    counts = rows.select(F.explode("_found.r").alias("r")).groupBy("r.stratum", "r.bin").count().collect()
    least = thresholds([tuple(r) for r in counts])

    def discovered(m: Column) -> Column:
        test = F.lit(False)
        for stratum, b in sorted(least.items()):
            test = test | ((m["r"]["stratum"] == stratum) & (m["r"]["bin"] >= b))
        return m["r"]["random"] & test

    accepted = F.filter("_found", discovered)
    return rows.select(key, F.array_sort(F.concat("_base", _spans(accepted, 3))).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
