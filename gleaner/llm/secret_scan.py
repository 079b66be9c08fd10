"""Secret scan by fixed patterns and a randomness test battery, JVM side only.

Base spans come from three patterns. The method adds spans of kind ``random``.
Candidates are all maximal strings of 20 or more characters of base64, base64url
or base62: a token behind ``/``, ``+``, ``-`` or ``_`` is tested alone as well as
with what it hangs on. Of reported strings that contain each other, the longest
is given. For each, an encoding is inferred (hex, base32, base62, base64) and three
statistics are taken: chi-squared uniformity over the alphabet (Wilson-Hilferty), a
runs test about the alphabet's middle, and lag-1 serial correlation of symbol
values. Each is standard normal if the string is random; for text its variance is
taken as 1 + n * ``TAU`` ** 2, as the shift grows with the root of the length n. With
the changes of character class, rare in text but after capitals, that gives a log-likelihood ratio of
"random in this encoding" to "text", as if the four were independent; by Markov's
inequality 2**-ratio bounds the p-value under "text". So each test moves the
p-value, and none is a gate. False discoveries are controlled at rate ``FDR`` by
Benjamini-Hochberg within length strata, over all strings of the corpus: the bits
of a stratum fit in a histogram of at most 201 bins, so the step-up threshold
needs no sort and no collected rows.

Offsets are code points, ends exclusive. Null text is empty. Rows are handled
one by one, so repeats, ties and null ids need no care; the work is linear in a
very long text but for a fold over its matches, in blocks; other columns play no
part, whatever their names (``scan`` replaces ``base`` and ``tested``); an empty
table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ENCODED = r"(?<![{0}])[{0}]{{20,}}={{0,2}}"
RUN = ENCODED.format("A-Za-z0-9+/_-")
#: within a run, what base64, base64url and the encodings without signs can cover
PARTS = tuple(map(ENCODED.format, ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9")))
KINDS = ("assign", "access", "hex", "random")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: name, pattern, alphabet, chance that neighbours differ in class if random
ENCODINGS = (
    ("hex", r"^[0-9a-f]+\z", DIGITS + "abcdef", 0.469),
    ("HEX", r"^[0-9A-F]+\z", DIGITS + "ABCDEF", 0.469),
    ("base32", r"^[A-Z2-7]+\z", UPPER + "234567", 0.305),
    ("base62", r"^[A-Za-z0-9]+\z", UPPER + LOWER + DIGITS, 0.622),
    ("base64", r"^[A-Za-z0-9+/]+\z", UPPER + LOWER + DIGITS + "+/", 0.644),
    ("base64url", r"^[A-Za-z0-9_-]+\z", UPPER + LOWER + DIGITS + "_-", 0.644),
)
TEXT_CHANGE, CAPITAL_CHANGE = 0.1, 0.5  # chance that the class changes in text; after a capital of mixed case
TAU = 0.3
FDR = 0.01
STRATA = (32, 48, 96)
BINS = 200


SPANS = "array<struct<start: int, end: int, s: string>>"
FOLD = 64


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, s>>: texts between matches give the offsets. The fold
    goes by blocks, since an array that grows by one element is copied each time."""
    none = F.expr(f"cast(array() as {SPANS})")
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.transform(between, lambda b: F.length(b)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

    def one(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("s"))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.struct(inner["at"].alias("at"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / FOLD).cast("int")), lambda j: F.slice(xs, j * FOLD + 1, F.lit(FOLD)))

    # a single block, as nearly all texts have, needs no outer fold
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    many = F.flatten(F.aggregate(blocks(pairs), F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPANS}>)").alias("out")), block)["out"])
    return F.when(~text.rlike(pattern), none).when(F.size(found) < FOLD, F.aggregate(pairs, start, one)["out"]).otherwise(many)


def _candidates(text: Column) -> Column:
    def parts(run: Column) -> Column:
        found = (F.transform(_matches(run["s"], part), lambda m: F.struct((run["start"] + m["start"]).alias("start"), (run["start"] + m["end"]).alias("end"), m["s"].alias("s"))) for part in PARTS)
        return F.array_distinct(F.concat(*found))

    return F.flatten(F.transform(_matches(text, RUN), parts))


def _encoded(c: Column) -> Column:
    s = F.regexp_replace(c["s"], r"=+\z", "")

    def pick(values: list) -> Column:
        return reduce(lambda rest, i: F.when(s.rlike(ENCODINGS[i][1]), F.lit(values[i])).otherwise(rest), reversed(range(len(ENCODINGS))), F.lit(None))

    return F.struct(c["start"], c["end"], s.alias("s"), pick([e[2] for e in ENCODINGS]).alias("alphabet"), pick([e[3] for e in ENCODINGS]).alias("change"))


def _symbols(c: Column) -> Column:
    chars = F.regexp_extract_all(c["s"], F.lit("(?s)."), F.lit(0))
    return F.struct(
        c["start"], c["end"], c["s"], c["change"],
        F.length(c["s"]).cast("double").alias("n"),
        F.length(c["alphabet"]).cast("double").alias("k"),
        F.transform(chars, lambda x: F.position(x, c["alphabet"]).cast("double")).alias("v"),
        F.transform(chars, lambda x: F.when(x.rlike("[0-9]"), 0).when(x.rlike("[a-z]"), 1).when(x.rlike("[A-Z]"), 2).otherwise(3)).alias("kind"),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + F.coalesce(x.cast("double"), F.lit(0.0)))


def _counts(c: Column) -> Column:
    n = c["n"]
    middle, mean = (c["k"] + 1) / 2, _sum(c["v"]) / n
    following, next_kind = (F.slice(c[name], 2, 1_000_000_000) for name in ("v", "kind"))
    mixed = F.array_contains(c["kind"], 1)  # with small letters, a capital may begin a word
    return F.struct(
        c["start"], c["end"], n.alias("n"), c["k"], c["change"],
        _sum(F.transform(F.array_distinct(c["v"]), lambda d: F.pow(F.size(F.filter(c["v"], lambda x: x == d)), F.lit(2.0)))).alias("squares"),
        _sum(F.transform(c["v"], lambda x: x > middle)).alias("above"),
        (_sum(F.zip_with(c["v"], following, lambda a, b: (a > middle) != (b > middle))) + 1).alias("runs"),
        _sum(F.transform(c["v"], lambda x: (x - mean) * (x - mean))).alias("spread"),
        _sum(F.zip_with(c["v"], following, lambda a, b: (a - mean) * (b - mean))).alias("serial"),
        _sum(F.zip_with(c["kind"], next_kind, lambda a, b: a != b)).alias("changes"),
        _sum(F.zip_with(c["kind"], next_kind, lambda a, b: mixed & (a == 2) & (a != b))).alias("capital_changes"),
        _sum(F.zip_with(c["kind"], next_kind, lambda a, b: mixed & (a == 2) & b.isNotNull())).alias("capitals"),
    )


def _tested(c: Column) -> Column:
    n, df = c["n"], c["k"] - 1
    chi = c["k"] / n * c["squares"] - n
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    mu = 2 * c["above"] * (n - c["above"]) / n + 1
    z_runs = F.try_divide(c["runs"] - mu, F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(0.0))))
    z_serial = F.try_divide(c["serial"], c["spread"]) * F.sqrt(n)
    spread = 1 + n * TAU**2

    def battery(z: Column) -> Column:
        """Bits for "random": the normal densities of variance 1 and ``spread`` at z."""
        return F.coalesce(F.log2(spread) / 2 - z * z / 2 * (1 - 1 / spread) * math.log2(math.e), F.lit(-float(BINS)))

    def classes(changed: Column, total: Column, in_text: float) -> Column:
        return changed * F.log2(c["change"] / in_text) + (total - changed) * F.log2((1 - c["change"]) / (1 - in_text))

    capitals, turned = c["capitals"], c["capital_changes"]
    changes = classes(turned, capitals, CAPITAL_CHANGE) + classes(c["changes"] - turned, n - 1 - capitals, TEXT_CHANGE)
    # uniformity is tested from above only: symbols more even than chance are no sign of text
    bits = changes + battery(F.greatest(z_chi, F.lit(0.0))) + battery(z_runs) + battery(z_serial)
    stratum = sum((n >= x).cast("int") for x in STRATA)
    return F.struct(
        c["start"], c["end"], stratum.alias("stratum"),
        F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(bits).cast("int"))).alias("bits"),
    )


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``base`` (kind number, start, end) and ``tested`` (the
    battery's results); one pass, no shuffle. Columns of these names are replaced."""
    text = F.coalesce(docs["text"], F.lit(""))
    long_enough = F.filter(_matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["s"], "(?s)^" + ASSIGN + r"\z", 2)) >= 8)

    def of(kind: int, spans: Column) -> Column:
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    base = F.sort_array(F.concat(of(0, long_enough), of(1, _matches(text, ACCESS)), of(2, _matches(text, HEX))))
    tested = F.transform(F.transform(F.transform(F.transform(_candidates(text), _encoded), _symbols), _counts), _tested)
    return docs.drop("base", "tested").withColumns({"base": base, "tested": tested})


def thresholds(scanned: DataFrame) -> list[int]:
    """For each length stratum the bits from which strings are reported
    (Benjamini-Hochberg on the histogram of bits over all tested strings)."""
    tests = scanned.select(F.explode("tested").alias("t")).select("t.stratum", "t.bits").groupBy("stratum", "bits").agg(F.count("*").alias("n"))
    # at most strata x (BINS + 1) rows, whatever the corpus
    bins = tests.groupBy("stratum").agg(F.collect_list(F.struct("bits", "n")).alias("bins"), F.sum("n").alias("m"))
    passing = F.filter(
        F.sequence(F.lit(1), F.lit(BINS)),
        lambda b: F.pow(F.lit(2.0), -b) * F.col("m")
        <= FDR * F.aggregate("bins", F.lit(0).cast("long"), lambda total, x: total + F.when(x["bits"] >= b, x["n"]).otherwise(F.lit(0).cast("long"))),
    )
    least = {r["stratum"]: r["least"] for r in bins.select("stratum", F.array_min(passing).alias("least")).collect()}  # a number a stratum
    return [least.get(i) or BINS + 1 for i in range(len(STRATA) + 1)]


def _outermost(reported: Column) -> Column:
    """Spans of the strings that no other reported one contains."""
    return F.aggregate(
        F.sort_array(F.transform(reported, lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("back")))),
        F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)"),
        lambda kept, t: F.when(F.get(kept, F.size(kept) - 1)["end"] >= -t["back"], kept).otherwise(
            F.concat(kept, F.array(F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), (-t["back"]).alias("end"))))
        ),
    )


def with_spans(scanned: DataFrame, least: list[int]) -> DataFrame:
    """Adds ``spans``: base ones and, from ``tested``, the reported random ones,
    by start, then kind."""
    bounds = F.array(*map(F.lit, least))
    reported = F.filter("tested", lambda t: t["bits"] >= F.get(bounds, t["stratum"]))
    spans = F.sort_array(F.concat("base", _outermost(reported)))
    return scanned.withColumn("spans", spans).drop("tested")


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span replaced; overlapping spans become one mark."""
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of each document."""
    scanned = materialize(scan(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")).drop("text"), "secrets")
    return with_spans(scanned, thresholds(scanned))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans of ``text`` replaced. Texts are scanned once: they are
    written with their test results, whose corpus-wide thresholds then decide."""
    rows = docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # no name of the input can clash
    scanned = materialize(scan(rows).select("row", "base", "tested"), "secret-tests")
    found = with_spans(scanned, thresholds(scanned))
    return found.select(F.col("row").withField("text", redacted(F.col("row.text"), F.col("spans"))).alias("row")).select("row.*")
