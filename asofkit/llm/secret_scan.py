"""Secret scans in DataFrame functions only: fixed patterns, then a battery of randomness tests.

Long runs of key-like characters are candidates. Under the hypothesis "drawn uniformly from the alphabet of
its encoding" each gets four p-values: chi-squared over the character classes, chi-squared over the
symbols, number of runs about the middle of the alphabet, and serial correlation. Bonferroni combines them.
Words, identifiers and numbers refute the hypothesis; Benjamini-Hochberg decides who does, separately per
encoding and length class, because the tests' power depends on the length. What is not refuted is reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import row_key

KINDS = ("assign", "access", "hex", "random")
# The patterns of the published contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED_CHARS = 12

RANDOM_CHARS = 24
RANDOM = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % RANDOM_CHARS
ISSUER = "^[a-z]{2,4}_"  # a short name before the key proper, which is not drawn at random
RATE = 0.05
GROUP = 64
BINS_PER_DECADE = 20
LAST_BIN = 800
#: Encoding: (symbols, symbols per class: upper, lower, digit, other).
ENCODINGS = {"hex": (16, (0, 6, 10, 0)), "HEX": (16, (6, 0, 10, 0)), "base32": (32, (26, 0, 6, 0)), "base64": (64, (26, 26, 10, 2))}
SPAN_TYPE = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, y: a + y["gap"] + y["match"])


def placed(parts: Column, kind: int, token: bool) -> Column:
    """Adds up the lengths of all parts before each: within groups of ``GROUP``, and over the groups before."""
    groups = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / GROUP).cast("int")), lambda g: total(F.slice(parts, g * GROUP + 1, F.lit(GROUP)))
    )

    def span(offsets: Column):
        def one(x: Column, i: Column) -> Column:
            group = F.floor(i / GROUP).cast("int")
            start = F.get(offsets, group) + total(F.slice(parts, group * GROUP + 1, i % GROUP)) + x["gap"]
            where = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["match"]).alias("end"))
            return F.struct(where.alias("span"), x["kept"].alias("kept"), *([x["token"].alias("token")] if token else []))

        return F.transform(parts, one)

    def before(sums: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(sums) - 1)
        return F.transform(numbers, lambda g: F.aggregate(F.slice(sums, F.lit(1), g), F.lit(0), lambda a, y: a + y))

    return let(groups, lambda sums: let(before(sums), span))


def matches(
    text: Column, pattern: str, kind: int, keep: Column | None = None, guard: Column | None = None, token: bool = False
) -> Column:
    """(start, kind, end) of the leftmost non-overlapping matches, in code points; with ``token`` (span, kept, token).

    The text between two matches is what splitting on the pattern leaves, which gives the places. Texts are searched once, and the
    work grows with the number of matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.transform(found, lambda _: F.lit(True)) if keep is None else keep
    parts = F.arrays_zip(
        F.split(text, pattern).alias("gap"), found.alias("match"), kept.alias("kept")
    )
    sized = F.transform(
        parts,
        lambda x: F.struct(
            F.length(x["gap"]).alias("gap"),
            F.coalesce(F.length(x["match"]), F.lit(0)).alias("match"),
            F.coalesce(x["kept"], F.lit(False)).alias("kept"),
            *([x["match"].alias("token")] if token else []),
        ),
    )
    spans = F.filter(let(sized, lambda s: placed(s, kind, token)), lambda s: s["kept"])
    if token:
        return spans
    result = F.transform(spans, lambda s: s["span"])
    none = F.array().cast(SPAN_TYPE)
    return result if guard is None else F.when(guard, result).otherwise(none)


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by start and kind; the guards skip texts that cannot match."""
    lowered = F.lower(text)
    words = reduce(lambda a, b: a | b, [lowered.contains(w) for w in ("passw", "secret", "token", "apikey", "api_key")])
    long_enough = F.transform(
        F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGNED_CHARS
    )
    return F.array_sort(
        F.concat(
            matches(text, ASSIGN, 0, long_enough, words),
            matches(text, ACCESS, 1, None, text.contains("AKIA")),
            matches(text, HEX, 2, None, text.rlike(HEX)),
        )
    )


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution (a rational approximation of erfc, error below 1.2e-7 of it)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.5 * x)
    # The published coefficients of the approximation.
    coefficients = (
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    )
    polynomial = reduce(lambda a, c: a * t + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]))
    tail = 0.5 * t * F.exp(polynomial - x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def by_encoding(value) -> Column:
    """``value(symbols, classes)`` of the row's encoding."""
    return reduce(
        lambda chain, e: chain.when(F.col("encoding") == e, value(*ENCODINGS[e])),
        list(ENCODINGS)[1:],
        F.when(F.col("encoding") == next(iter(ENCODINGS)), value(*ENCODINGS[next(iter(ENCODINGS))])),
    )


def symbol_index(c: Column) -> Column:
    """Place in the alphabet of the row's encoding."""
    code = F.ascii(c)
    digit, upper, lower = code.between(48, 57), code.between(65, 90), code.between(97, 122)
    hexed = F.when(digit, code - 48).when(upper, code - 55).otherwise(code - 87)
    base32 = F.when(upper, code - 65).otherwise(code - 24)
    base64 = F.when(upper, code - 65).when(lower, code - 71).when(digit, code + 4).when(c.isin("+", "-"), 62).otherwise(63)
    return F.when(F.col("encoding").isin("hex", "HEX"), hexed).when(F.col("encoding") == "base32", base32).otherwise(base64)


def tested(candidates: DataFrame) -> DataFrame:
    """Adds ``encoding``, ``length`` and the combined ``p`` to rows with a ``token``."""
    body = F.regexp_replace(F.rtrim(F.col("token"), F.lit("=")), ISSUER, "")
    both = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    encoding = (
        F.when(both & body.rlike("^[0-9a-f]+$"), "hex")
        .when(both & body.rlike("^[0-9A-F]+$"), "HEX")
        .when(both & body.rlike("^[A-Z2-7]+$"), "base32")
        .otherwise("base64")
    )
    df = candidates.withColumns({"body": body, "encoding": encoding}).withColumn("length", F.length("body"))
    df = df.withColumn("symbols", F.transform(F.split("body", ""), symbol_index))
    n = F.col("length").cast("double")
    counts = F.array(
        *(F.length(F.regexp_replace("body", p, "")).cast("double") for p in ("[^A-Z]", "[^a-z]", "[^0-9]", "[A-Za-z0-9]"))
    )
    df = df.withColumn("classes", counts)

    def class_chi(size: int, classes: tuple[int, ...]) -> Column:
        used = [(i, k / size) for i, k in enumerate(classes) if k]
        chi = reduce(lambda a, b: a + b, [F.pow(F.get("classes", F.lit(i)) - n * s, F.lit(2.0)) / (n * s) for i, s in used])
        free = len(used) - 1
        return (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / (2 / (9 * free)) ** 0.5

    def symbol_chi(size: int, _: tuple[int, ...]) -> Column:
        squares = F.aggregate(
            F.sequence(F.lit(0), F.lit(size - 1)),
            F.lit(0.0),
            lambda a, k: a + F.pow(F.size(F.filter("symbols", lambda x: x == k)).cast("double"), F.lit(2.0)),
        )
        return (squares * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (1 - 1 / n))

    size = by_encoding(lambda s, _: F.lit(s))
    above = F.transform("symbols", lambda x: (2 * x >= F.col("size")).cast("int"))
    df = df.withColumns({"z_class": by_encoding(class_chi), "z_symbol": by_encoding(symbol_chi), "size": size})
    df = df.withColumn("above", above)
    ones = F.aggregate("above", F.lit(0), lambda a, x: a + x).cast("double")
    runs = 1 + F.size(F.filter(F.transform("above", lambda x, i: x != F.get("above", i - 1)), lambda x: x))
    df = df.withColumns({"ones": ones, "runs": runs.cast("double")})
    zeros = n - F.col("ones")
    mean = 1 + 2 * F.col("ones") * zeros / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = F.when(variance > 0, F.abs(F.col("runs") - mean) / F.sqrt(variance)).otherwise(F.lit(40.0))
    middle = F.aggregate("symbols", F.lit(0), lambda a, x: a + x) / n
    df = df.withColumns({"z_runs": z_runs, "middle": middle})
    spread = F.aggregate("symbols", F.lit(0.0), lambda a, x: a + F.pow(x - F.col("middle"), F.lit(2.0)))
    lagged = F.aggregate(
        F.transform(
            "symbols",
            lambda x, i: F.coalesce((x - F.col("middle")) * (F.get("symbols", i + 1) - F.col("middle")), F.lit(0.0)),
        ),
        F.lit(0.0),
        lambda a, x: a + x,
    )
    df = df.withColumns({"spread": spread, "lagged": lagged})
    z_serial = F.when(
        F.col("spread") > 0, F.abs(F.col("lagged") / F.col("spread") + 1 / (n - 1)) * F.sqrt(n)
    ).otherwise(F.lit(40.0))
    least = F.least(
        normal_tail(F.col("z_class")), normal_tail(F.col("z_symbol")), 2 * normal_tail(F.col("z_runs")), 2 * normal_tail(z_serial)
    )
    return df.withColumn("p", F.least(F.lit(1.0), 4 * F.coalesce(least, F.lit(0.0))))


def not_refuted(candidates: DataFrame, rate: float = RATE) -> DataFrame:
    """The candidates that pass as random. P-values are counted in bins, so the procedure needs no global sort."""
    bin_of = F.least(
        F.lit(LAST_BIN), F.floor(-BINS_PER_DECADE * F.log10(F.greatest(F.col("p"), F.lit(1e-300)))).cast("int")
    )
    scored = tested(candidates).withColumns({"stratum": F.floor(F.log2(F.col("length").cast("double"))), "bin": bin_of})
    strata = ["encoding", "stratum"]
    counts = scored.groupBy(*strata, "bin").agg(F.count(F.lit(1)).alias("n"))  # at most 4 x 31 x 801 rows
    smaller = Window.partitionBy(*strata).orderBy(F.desc("bin"))
    largest_p = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE)
    cuts = (
        counts.withColumns({"up_to": F.sum("n").over(smaller), "all": F.sum("n").over(Window.partitionBy(*strata))})
        .filter(largest_p <= rate * F.col("up_to") / F.col("all"))
        .groupBy(*strata)
        .agg(F.min("bin").alias("cut"))
    )
    return scored.join(F.broadcast(cuts), strata, "left").filter(F.coalesce(F.col("bin") < F.col("cut"), F.lit(True)))


def secrets(documents: DataFrame, rate: float = RATE) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans and the span structs.

    A span covers the whole match, in code points, end exclusive. A random run that meets a fixed span is not
    repeated. A null or empty text has no spans; each input row gives one row, and rows of one id with different
    texts are told apart. Columns other than doc_id and text are not looked at.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", row_key())
    text = F.col("text")
    candidates = (
        docs.filter(text.rlike(RANDOM))
        .select("doc_id", "row_key", F.explode_outer(matches(text, RANDOM, 3, token=True)).alias("found"))
        .select("doc_id", "row_key", "found.span", "found.token")
        .filter(F.col("span").isNotNull())
    )
    found = (
        not_refuted(candidates, rate)
        .groupBy(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_key"))
        .agg(F.collect_set("span").alias("random"))
    )
    slim = docs.select("doc_id", "row_key", base_spans(text).alias("base"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_key"))
    joined = slim.join(found, same, "left")
    apart = F.filter(
        F.coalesce("random", F.array().cast(SPAN_TYPE)),
        lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])),
    )
    all_spans = F.array_sort(F.concat("base", apart))

    def named(spans: Column) -> Column:
        kinds = F.array(*map(F.lit, KINDS))
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def number(kind: int) -> Column:
        return F.size(F.filter("all_spans", lambda s: s["kind"] == kind)).cast("long")

    return joined.withColumn("all_spans", all_spans).select(
        "doc_id",
        "row_key",
        *(number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        named(F.col("all_spans")).alias("spans"),
        "all_spans",
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span replaced by the mark; of spans that meet, the outline is replaced once."""
    begin = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        piece = F.when(
            s["start"] >= state["end"],
            F.array(F.substring(text, state["end"] + 1, s["start"] - state["end"]), F.lit(mark)),
        ).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(state["end"], s["end"]).alias("end"), F.concat(state["parts"], piece).alias("parts"))

    last = F.length(text)
    return F.aggregate(
        spans, begin, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["end"] + 1, last))
    )
