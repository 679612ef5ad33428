"""Secrets in texts: fixed patterns, and runs of characters that look random.

Two Markov models over characters, of random strings and of ordinary identifiers, are trained from
labelled samples. A long run of key-like characters is a secret if the log-likelihood ratio of the
models says random by ``MARGIN`` or more. The models are one table of log ratios by pair of
characters, whose size the alphabet fixes; it is a constant of the query plan. Everything is
DataFrame and SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import table
from scholion.llm.spans import matches

#: In the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: Runs are longest possible, so a least length in the pattern drops what is too short.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
RUN = "[A-Za-z0-9+/_=-]{20,}"

#: Labelled samples of either label.
SAMPLES = 4000
#: The log-likelihood ratio, in nats, from which on a run is a secret.
MARGIN = 12.0

_LOW, _SPAN = 43, 80  # the codes of all characters of RUN lie from 43 ("+") to 122 ("z")

# Ordinary words that identifiers are made of.
_HEADS = "get set is has make find load save open close read write count parse format update delete create merge split filter sort index cache check render handle build start stop".split()
_BODIES = "user account order invoice customer document record session message payment language network request response template password configuration directory temporary available information environment government international organization understanding responsibility".split()
_TAILS = "name id list size type value table path file data node item state error event buffer result option handler service manager controller exception".split()
#: Characters whose repeats are ordinary: rules, blanks to fill in, placeholders.
_RULES = "-=_+/xXaA0"


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(``text``, ``random``): ``n`` ordinary identifiers in several styles, and as many random strings in several alphabets, made by rule."""
    at = F.col("id")

    def pick(words: list[str], salt: int) -> Column:
        return F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64(at, F.lit(salt)), F.lit(len(words))).cast("int"))

    parts = [pick(_HEADS, 1), pick(_BODIES, 2), pick(_BODIES, 3), pick(_TAILS, 4)]
    snake, digest = F.concat_ws("_", *parts), F.sha2(at.cast("string"), 256)
    camel = F.concat(parts[0], *map(F.initcap, parts[1:]))
    base64 = F.base64(F.unhex(digest))
    ordinary = [snake, camel, F.upper(snake), F.concat_ws("-", *parts), F.concat_ws("/", *parts), F.concat(*parts), F.initcap(F.concat(parts[1], parts[2])), F.concat(snake, F.pmod(at, F.lit(100)).cast("string")), F.repeat(pick(list(_RULES), 5), F.lit(40))]
    random = [digest, base64, F.translate(base64, "+/=", ""), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)), F.translate(base64, "+/=", "-_")]

    def styles(made: list[Column]) -> Column:
        return F.get(F.array(*made), F.pmod(at, F.lit(len(made))).cast("int"))

    rows = spark.range(n)
    return rows.select(styles(ordinary).alias("text"), F.lit(0).alias("random")).union(rows.select(styles(random).alias("text"), F.lit(1).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """The log ratio of the two models for each pair of characters, random over ordinary, with add-one smoothing.

    Labels are 0 and 1; null texts and characters outside the models' range are passed over. Without
    samples every ratio is zero.
    """
    codes = F.transform(F.filter(F.split("text", ""), lambda c: F.length(c) == 1), lambda c: F.ascii(c) - _LOW)
    pairs = F.zip_with(codes, F.slice(codes, 2, 1 << 30), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    counted = samples.filter("random IN (0, 1)").select("random", F.explode(pairs).alias("x")).filter(f"x.a BETWEEN 0 AND {_SPAN - 1} AND x.b BETWEEN 0 AND {_SPAN - 1}")
    seen = {(x["random"], x["a"], x["b"]): x["count"] for x in counted.groupBy("random", "x.a", "x.b").count().collect()}
    used = len({b for _, _, b in seen}) or 1
    sums: dict[tuple[int, int], int] = {}
    for (label, a, _), n in seen.items():
        sums[label, a] = sums.get((label, a), 0) + n

    def log_share(label: int, a: int, b: int) -> float:
        return math.log((seen.get((label, a, b), 0) + 1) / (sums.get((label, a), 0) + used))

    return [round(log_share(1, a, b) - log_share(0, a, b), 5) for a in range(_SPAN) for b in range(_SPAN)]


def log_ratio(run: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a run of key-like characters."""
    ratios = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.transform(F.filter(F.split(run, ""), lambda c: F.length(c) == 1), lambda c: F.ascii(c) - _LOW)
    pairs = F.zip_with(codes, F.slice(codes, 2, 1 << 30), lambda a, b: a * _SPAN + b)
    return F.aggregate(F.filter(pairs, lambda k: k.isNotNull()), F.lit(0.0), lambda acc, k: acc + F.get(ratios, k))


def _of_kind(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["found"].alias("found")))


def find_secrets(docs: DataFrame, model: list[float], *, id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """One row for each row of ``docs``: the id and ``spans``, an array of ``start``, ``rank``, ``end``, ``kind``, ``found``.

    Places are in code points, the end exclusive. Spans are in order of start, then of ``KINDS``.
    Spans of the fixed patterns may overlap those of other kinds; a ``markov`` span overlaps none.
    Null and empty texts have no spans. Rows are taken one by one, whatever their ids; an empty table
    gives an empty result; columns other than the two named are ignored. Whole texts are searched.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["found"], ASSIGN, 2)) >= ASSIGN_LEAST)
    base = F.array_sort(F.concat(_of_kind("assign", assign), _of_kind("access", matches(text, ACCESS)), _of_kind("hex", matches(text, HEX))))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", base.alias("base"), matches(text, RUN).alias("runs"))

    def pieces(run: Column) -> Column:
        """What base spans leave of a run, where it is long enough: from the run's start, and from each base span's end, to the next base span."""
        met = F.filter("base", lambda y: (y["start"] < run["end"]) & (run["start"] < y["end"]))
        starts = F.array_distinct(F.concat(F.array(run["start"]), F.transform(met, lambda y: y["end"])))
        starts = F.filter(starts, lambda a: (a < run["end"]) & ~F.exists(met, lambda y: (y["start"] <= a) & (a < y["end"])))
        ends = F.transform(starts, lambda a: F.struct(a.alias("start"), F.array_min(F.concat(F.array(run["end"]), F.transform(F.filter(met, lambda y: y["start"] > a), lambda y: y["start"]))).alias("end")))
        cut = F.transform(ends, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substr(run["found"], x["start"] - run["start"] + 1, x["end"] - x["start"]).alias("found")))
        return F.filter(cut, lambda x: x["found"].rlike(f"^(?:{RUN})$"))

    random = F.filter(F.flatten(F.transform("runs", pieces)), lambda x: log_ratio(x["found"], model) >= margin)
    return found.select(F.col("id").alias(id_col), F.array_sort(F.concat("base", _of_kind("markov", random))).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), train(labelled_samples(spark)))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "markov")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
