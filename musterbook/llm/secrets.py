"""Secrets in texts: fixed patterns, and a battery of randomness tests.

Three patterns give the base spans. Beside them every long token is a candidate, also one that
follows or precedes an "=". Its encoding is inferred from its characters (hex, letters of one or of both
cases, base32, base64) and three tests compare it with uniform random symbols of that encoding:
chi-squared of the symbol counts, runs above and below the middle of the alphabet, and the
lag-one serial correlation. Tokens of letters only take a fourth: whether they prefer the letters that
words prefer. The scores are combined into one p-value of "random"; ordinary text has p near
0, random tokens a uniform p.

False discoveries are controlled per encoding and band of length, since short tokens test
weakly: among the candidates of a band, twice the number with p > 1/2 estimates how many
are random, so what passes a threshold beyond the random ones' share is false. The lowest
threshold whose estimated share of false ones is at most ``FDR`` holds; a band without
one reports nothing.

Defined results: a NULL text is empty; no match gives empty lists; repeated rows are judged alike;
positions count code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterbook.llm.common import fresh

# The kinds in order, and what they match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"([0-9a-f]{24,})"
KINDS = ["assign", "access", "hex", "random"]
LEAST_ASSIGNED = 6

CANDIDATE = r"(?<![A-Za-z0-9+/_-])([A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?)"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
LETTERS = ["lower", "upper", "letters"]
# How often words have each letter, a to z, in hundredths of a percent.
USUAL = [817, 149, 278, 425, 1270, 223, 202, 609, 697, 15, 77, 403, 241, 675, 751, 193, 10, 599, 633, 906, 276, 98, 236, 15, 197, 7]
BANDS = [24, 32, 48, 64, 128]
FDR = 0.05
GRID = 20
# Values of a list that are taken one after the other; longer lists are cut.
STRETCH = 128


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points.

    Splitting by the pattern gives the pieces between the matches, so positions are running
    sums of lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The piece after the last match has no value.
    pairs = F.filter(
        F.zip_with(F.split(text, pattern), found, lambda p, v: F.struct(F.length(p).alias("gap"), v.alias("value"))),
        lambda p: p["value"].isNotNull(),
    )

    def spans(p):
        ends = running(F.transform(p, lambda x: (x["gap"] + F.length(x["value"])).cast("long")), lambda a, x: a + x)
        return F.zip_with(
            p, ends, lambda x, e: F.struct((e - F.length(x["value"])).alias("start"), e.alias("end"), x["value"].alias("value"))
        )

    return F.when(text.rlike(pattern), _let(pairs, spans))


def running(values: Column, combine) -> Column:
    """Totals of an array of longs up to each place, by an associative ``combine`` with neutral value 0.

    In two levels, so that a list which grows by one value at a time stays short.
    """

    def short(v):
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("totals"))

        def step(a, x):
            return F.struct(combine(a["at"], x).alias("at"), F.concat(a["totals"], F.array(combine(a["at"], x))).alias("totals"))

        return F.aggregate(v, start, step, lambda a: a["totals"])

    def joined(parts):
        return _let(
            short(F.transform(parts, lambda p: F.element_at(p, -1))),
            lambda totals: F.flatten(
                F.transform(parts, lambda p, k: F.transform(p, lambda x: combine(F.coalesce(F.get(totals, k - 1), F.lit(0).cast("long")), x)))
            ),
        )

    return _let(values, lambda v: _let(F.transform(stretches(v), short), joined))


def stretches(v: Column) -> Column:
    """An array cut into arrays of ``STRETCH`` values."""
    last = F.floor((F.size(v) - 1) / STRETCH).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(v, k * STRETCH + 1, STRETCH))
    return F.filter(cut, lambda c: F.size(c) > 0)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) by a rational approximation of the complementary error function."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.greatest(poly * F.exp(-x * x), F.lit(0.0)), F.lit(1.0))


def encoding_of(token: Column) -> Column:
    """Struct of the inferred encoding, its alphabet, and the token's symbols in that alphabet."""
    body = F.regexp_replace(token, "=+$", "")
    name = (
        F.when(body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(body.rlike("^[a-z]+$"), "lower")
        .when(body.rlike("^[A-Z]+$"), "upper")
        .when(body.rlike("^[A-Za-z]+$"), "letters")
        .when(body.rlike("^[A-Z2-7]+$"), "base32")
        .otherwise("base64")
    )

    def alphabet_of(encoding):
        alphabet = F.lit(ALPHABETS["base64"])
        for other in ("hex", *LETTERS, "base32"):
            alphabet = F.when(encoding == other, F.lit(ALPHABETS[other])).otherwise(alphabet)
        return alphabet

    return _let(
        F.struct(name.alias("encoding"), body.alias("body")),
        lambda e: F.struct(
            e["encoding"].alias("encoding"),
            alphabet_of(e["encoding"]).alias("alphabet"),
            F.when(e["encoding"] == "hex", F.lower(e["body"])).otherwise(F.translate(e["body"], "-_", "+/")).alias("body"),
        ),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def scores(encoded: Column) -> Column:
    """Struct of the normal scores of the tests for an ``encoding_of`` struct; ``words`` is NULL beside letters."""
    alphabet, body = encoded["alphabet"], encoded["body"]
    size, n = F.length(alphabet).cast("double"), F.length(body).cast("double")
    counts = F.transform(F.split(alphabet, ""), lambda c: n - F.length(F.replace(body, c, F.lit(""))))
    chi2 = _sum(F.transform(counts, lambda c: c * c)) * size / n - n
    # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal.
    free = size - 1
    spread = F.lit(2.0) / (free * 9)
    z_chi = (F.pow(F.greatest(chi2, F.lit(0.0)) / free, F.lit(1 / 3)) - (F.lit(1.0) - spread)) / F.sqrt(spread)
    numbers = F.transform(F.split(body, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    middle = (size - 1) / 2

    def steps(v):
        # Under uniform symbols a step changes halves with probability 1/2.
        changes = _sum(
            F.transform(v, lambda x, i: F.when((x > middle) != (F.get(v, i - 1) > middle), F.lit(1.0)).otherwise(F.lit(0.0)))
        )
        products = _sum(
            F.transform(v, lambda x, i: F.coalesce((x - middle) * (F.get(v, i - 1) - middle), F.lit(0.0)))
        )
        return F.struct(
            ((changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)).alias("runs"),
            (products / ((size * size - 1) / 12 * F.sqrt(n - 1))).alias("serial"),
        )

    # Under uniform letters the sum of their logarithmic frequencies is nearly normal; words are far above.
    logs = [math.log(u) for u in USUAL]
    mean = sum(logs) / len(logs)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in logs) / len(logs))
    usual = F.array(*[F.lit((x - mean) / deviation) for x in logs])
    preferred = _sum(F.transform(F.split(F.lower(body), ""), lambda c: F.get(usual, F.ascii(c) - 97))) / F.sqrt(n)
    words = F.when(encoded["encoding"].isin(LETTERS), preferred)

    return _let(
        _let(numbers, steps),
        lambda z: F.struct(z_chi.alias("chi"), z["runs"].alias("runs"), z["serial"].alias("serial"), words.alias("words")),
    )


def battery(token: Column) -> Column:
    """Struct of a token's encoding, band of length and ``cell``, its p-value of "random" in steps of 1 / GRID."""

    def combined(z):
        # Only too uneven counts and usual letters speak against randomness; runs and serial correlation do so either way.
        def above(score):
            tail = _normal_tail(score) / 2
            return F.when(score > 0, tail).otherwise(1 - tail)

        # F.least leaves NULL out.
        words = F.when(z["words"].isNotNull(), above(z["words"]))
        least = F.least(above(z["chi"]), _normal_tail(z["runs"]), _normal_tail(z["serial"]), words)
        # The distribution function of the least of so many uniform values.
        return 1 - F.pow(1 - least, F.when(z["words"].isNull(), F.lit(3.0)).otherwise(F.lit(4.0)))

    def judged(e):
        length = F.length(e["body"])
        band = sum((F.when(length >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
        cell = F.least(F.floor(_let(scores(e), combined) * GRID), F.lit(GRID - 1)).cast("int")
        return F.struct(e["encoding"].alias("encoding"), band.alias("band"), cell.alias("cell"))

    return _let(encoding_of(token), judged)


def thresholds(tokens: DataFrame, token: str = "token", fdr: float = FDR) -> DataFrame:
    """Per encoding and band: the least cell from which the estimated share of false ones is within ``fdr``."""
    counts = tokens.select(battery(F.col(token)).alias("t")).groupBy("t.encoding", "t.band", "t.cell").agg(F.count("*").alias("n"))
    levels = counts.groupBy("encoding", "band").agg(
        F.sum(F.when(F.col("cell") >= GRID // 2, F.col("n")).otherwise(0)).alias("upper"),
        F.collect_list(F.struct("cell", "n")).alias("cells"),
    )
    passing = F.transform(
        F.sequence(F.lit(0), F.lit(GRID - 1)),
        lambda k: F.struct(
            k.alias("cell"),
            F.aggregate(
                F.filter("cells", lambda c: c["cell"] >= k), F.lit(0).cast("bigint"), lambda a, c: a + c["n"]
            ).alias("n"),
        ),
    )
    random = 2.0 * F.col("upper")
    fit = F.filter(passing, lambda c: (c["n"] > 0) & (c["n"] - random * (1 - c["cell"] / GRID) <= fdr * c["n"]))
    return levels.select("encoding", "band", F.array_min(fit)["cell"].alias("least")).where("least is not null")


def random_spans(docs: DataFrame, text: str = "text", fdr: float = FDR) -> Column:
    """Spans of the candidates that the battery, with thresholds learned on ``docs``, takes for random."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # A token that many documents repeat is one observation.
    tokens = docs.select(F.explode(match_spans(whole, CANDIDATE)).alias("s")).select(F.col("s.value").alias("token")).distinct()
    levels = thresholds(tokens, "token", fdr).collect()  # at most encodings times bands
    if not levels:
        return _none()

    def passes(t):
        least = F.lit(GRID)
        for r in levels:
            least = F.when((t["encoding"] == r.encoding) & (t["band"] == r.band), F.lit(r.least)).otherwise(least)
        return t["cell"] >= least

    return F.coalesce(F.filter(match_spans(whole, CANDIDATE), lambda s: _let(battery(s["value"]), passes)), _none())


def _none() -> Column:
    return F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")


def find_secrets(docs: DataFrame, text: str = "text", fdr: float = FDR) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns of spans (start, kind number, end) in order: the base ones, and all.

    A random token inside a base span is that span. Returns the names of the two columns too.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    assigned = F.filter(
        match_spans(whole, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST_ASSIGNED
    )
    found = [assigned, match_spans(whole, ACCESS), match_spans(whole, HEX), random_spans(docs, text, fdr)]

    def numbered(spans, kind):
        return F.transform(
            F.coalesce(spans, _none()), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))
        )

    base, every, extra = fresh(docs, "base_spans"), fresh(docs, "all_spans"), fresh(docs, "__random")
    df = docs.withColumns(
        {
            base: F.array_sort(F.concat(*[numbered(s, k) for k, s in enumerate(found[:3])])),
            extra: numbered(found[3], 3),
        }
    )

    def uncovered(spans):
        # In order of start, base spans first, a random one is covered if a base span before it ends no earlier.
        reach = running(F.transform(spans, lambda x: F.when(x["kind"] == 3, F.lit(0).cast("long")).otherwise(x["end"])), F.greatest)
        marked = F.zip_with(spans, reach, lambda x, r: F.struct(x.alias("span"), r.alias("reach")))
        kept = F.filter(marked, lambda m: (m["span"]["kind"] != 3) | (m["reach"] < m["span"]["end"]))
        return F.transform(kept, lambda m: m["span"])

    merged = F.array_sort(F.concat(F.col(base), F.col(extra)))
    return df.withColumn(every, _let(merged, uncovered)).drop(extra), base, every


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping spans are one."""
    df, base, every = find_secrets(docs, text, fdr)
    whole = F.col(f"`{text}`")
    none = F.lit(0).cast("long")

    def clear(spans):
        """(start, end) of what lies before, between and behind the spans."""
        reach = running(F.transform(spans, lambda s: s["end"]), F.greatest)

        def gaps(r):
            every_gap = F.transform(
                spans, lambda s, i: F.struct(F.coalesce(F.get(r, i - 1), none).alias("start"), s["start"].alias("end"))
            )
            rest = F.struct(F.element_at(r, -1).alias("start"), F.length(whole).cast("long").alias("end"))
            return F.concat(F.filter(every_gap, lambda g: g["start"] <= g["end"]), F.array(rest))

        return _let(reach, gaps)

    def cut(gaps):
        # A place in a text is found by counting from its start, so gaps are cut from short stretches of it.
        first, last = F.get(gaps, 0)["start"], F.element_at(gaps, -1)["end"]
        return _let(
            F.struct(first.alias("at"), F.substring(whole, (first + 1).cast("int"), (last - first).cast("int")).alias("text")),
            lambda part: F.transform(
                gaps, lambda g: F.substring(part["text"], (g["start"] - part["at"] + 1).cast("int"), (g["end"] - g["start"]).cast("int"))
            ),
        )

    parts = F.flatten(F.transform(_let(_let(F.col(every), clear), stretches), cut))
    cleaned = F.when(F.size(every) > 0, F.array_join(parts, mark)).otherwise(whole)
    return df.withColumn(text, cleaned).select(*docs.columns)
