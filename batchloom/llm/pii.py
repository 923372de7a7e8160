"""Personal data by seed expressions and bootstrapped context patterns, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchloom.llm.scratch import Scratch
from batchloom.llm.skew import attach, row_numbers

KINDS = ("email", "ip", "card", "phone")

#: Distinct instances that a pattern needs; score from which a pattern or an instance is believed; steps in which instances are scored.
SUPPORT, CONFIDENT, STEPS = 5, 0.8, 1000

_SPACE = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"

_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Seed expressions. Each finds the leftmost longest spans that its kind's plain
#: form does, but may begin only where a span can (at the start of a run, or
#: right after the span before), and never gives back: time is linear in the text.
_SEEDS = {
    "email": ("@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (None, r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"),
    "phone": ("+", r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: What an unseen identifier may look like: numbers in groups, and names at hosts.
_CANDIDATE = (r"(?<![A-Za-z0-9_@.+(-])\(?[0-9](?:[ ().-]{0,2}[0-9]){5,18}+(?![A-Za-z0-9@])"
              r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?[\[({]at[\])}] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[({]dot[\])}] ?)[A-Za-z0-9-]++)*+")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    back = F.reverse(_digits(value))
    one = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, F.when(one(i) > 4, 2 * one(i) - 9).otherwise(2 * one(i))).otherwise(one(i))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(back)), doubled), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _holds(kind: Column, value: Column) -> Column:
    """Whether a span found for a kind counts: octets, number of digits, check digit."""
    n = F.char_length(_digits(value))
    return (F.when(kind == "ip", value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
            .when(kind == "phone", n.between(9, 15)).when(kind == "card", _luhn(value)).otherwise(F.lit(True)))


def _spans(docs: DataFrame, kind: str, mark: str | None, pattern: str) -> DataFrame:
    """``row, kind, start, end, value, last, second`` of each match; code points, end exclusive.

    Matches and the gaps between them add up to the positions, in a running sum
    over the spans of one text. ``last`` and ``second`` are the last two words
    of the gap before it.
    """
    found = docs.filter(F.col("text").contains(mark) if mark else F.col("text").rlike("[0-9@]"))
    parts = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("value"), F.split("text", pattern, -1).alias("gap"))
    spans = found.select("row", F.posexplode(parts).alias("i", "part")).select(
        "row", "i", F.col("part.value").alias("value"), F.char_length("part.gap").alias("before"), F.col("part.gap").alias("gap")).filter("value is not null")
    spans = spans.withColumn("gap", F.rtrim(F.translate("gap", _SPACE, " " * len(_SPACE)))).withColumn("last", F.substring_index("gap", " ", -1))
    rest = F.rtrim(F.col("gap").substr(F.lit(1), F.char_length("gap") - F.char_length("last")))
    spans = spans.withColumn("second", F.substring_index(rest, " ", -1)).drop("gap")
    so_far = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = spans.withColumn("end", F.sum(F.col("before") + F.char_length("value")).over(so_far))
    return ends.select("row", F.lit(kind).alias("kind"), (F.col("end") - F.char_length("value")).cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value", "last", "second")


def _contexts(spans: DataFrame) -> DataFrame:
    """Each span with the patterns it stands in: its last word before, and its last two, digits told apart by their runs only."""
    word = lambda name: F.regexp_replace(F.lower(name), "[0-9]+", "0")
    one = F.when(F.col("last") != "", F.concat(F.lit("1 "), word("last")))
    two = F.when(F.col("second") != "", F.concat(F.lit("2 "), word("second"), F.lit(" "), word("last")))
    return spans.withColumn("pattern", F.explode(F.array_compact(F.array(one, two)))).drop("last", "second")


def _shape(kind: Column, value: Column) -> Column:
    """Whether a candidate could be of a kind at all."""
    n = F.char_length(_digits(value))
    mail = value.rlike("[A-Za-z]") & value.rlike(r"@|[\[({]at")
    return (F.when(kind == "email", mail).when(kind == "phone", ~mail & n.between(7, 15)).when(kind == "card", ~mail & n.between(12, 19))
            .otherwise(value.rlike(r"^[0-9]{1,3}([.-][0-9]{1,3}){3}$")))


def believe(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``pattern, as, score, all`` of the patterns that are believed in the end.

    ``edges`` are ``pattern, kind, value, n``: how often an instance, of a kind
    or an unknown one (empty), stands in a pattern. Instances' scores are
    rounded down to a step of 1 / STEPS; as they can only rise from round to
    round, there is an end.
    """
    totals = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
    uses = scratch.keep(edges.filter("kind = ''").groupBy("value").agg(F.count("*").alias("uses")), "uses")
    scored = edges.withColumn("as", F.explode(F.when(F.col("kind") != "", F.array("kind")).otherwise(F.array(*map(F.lit, KINDS)))))
    believed = None
    while True:
        if believed is None:
            worth = scored.withColumn("worth", (F.col("kind") == F.col("as")).cast("double"))
        else:
            worth = attach(scored, believed, ["value", "as"], "uses", F.col("pattern"), "left")
            worth = worth.withColumn("worth", F.when(F.col("kind") == F.col("as"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        sums = worth.groupBy("pattern", "as").agg(F.sum(F.col("n") * F.col("worth")).alias("sum"), F.sum((F.col("worth") >= CONFIDENT).cast("long")).alias("support"))
        patterns = sums.filter(F.col("support") >= SUPPORT).join(totals, "pattern").withColumn("score", F.col("sum") / F.col("all")).filter(F.col("score") >= CONFIDENT)
        patterns = scratch.keep(patterns.select("pattern", "as", "score", "all"), "patterns")
        reached = attach(edges.filter("kind = ''").select("pattern", "value"), patterns, ["pattern"], "all", F.col("value"))
        reached = reached.filter(_shape(F.col("as"), F.col("value"))).groupBy("value", "as").agg((F.floor(F.max("score") * STEPS) / STEPS).cast("double").alias("score"))
        previous, believed = believed, scratch.keep(reached.join(uses, "value"), "believed")
        known = believed if previous is None else believed.join(previous.select("value", "as", "score"), ["value", "as", "score"], "left_anti")
        if known.isEmpty():
            return patterns


def discover(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of stored ``docs`` (``row, doc_id``) and the spans of personal data in them.

    Spans: ``row, kind, start, end, value, seed``. Seeds are what the
    expressions of the four kinds find. Spans of an identifier's shape that
    touch no seed are candidates. The words before a span are its patterns.
    Patterns and instances (distinct values) form a graph. A pattern's score
    for a kind is the mean over its occurrences of what its instances are worth
    as that kind: 1 for a seed of it, 0 for a seed of another, and else the
    instance's score, which is the best of its patterns in the round before.
    A pattern is believed if it scores CONFIDENT over at least SUPPORT distinct
    instances that do; what believed patterns reach is believed in the next
    round, and may make further patterns so, until nothing changes. Candidates
    believed then, of a shape that their kind can have, are the spans that are
    no seeds. A pattern's words lie between its span and the one before it of
    the same kind, or the start of the text.

    Null texts count as empty. Repeated rows each have their spans; other
    columns are not read; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    source = row_numbers(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")), "row")
    all_ = None
    for kind, (mark, pattern) in {**_SEEDS, "": (None, _CANDIDATE)}.items():
        one = _spans(source, kind, mark, pattern)
        all_ = one if all_ is None else all_.unionByName(one)
    found = scratch.keep(all_.filter((F.col("kind") == "") | _holds(F.col("kind"), F.col("value"))), "spans")
    seeds = found.filter("kind <> ''").withColumn("seed", F.lit(True))
    # A candidate stands alone: no seed of its text overlaps it. Seeds of a text in order of their ends so far.
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    is_seed = F.col("kind") != ""
    ranked = found.withColumn("rank", F.when(is_seed, 0).otherwise(1))
    ranked = ranked.withColumn("reach", F.max(F.when(is_seed, F.col("end"))).over(before)).withColumn("next", F.min(F.when(is_seed, F.col("start"))).over(after))
    free = ranked.filter(~is_seed & (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))).drop("rank", "reach", "next")
    spans = scratch.keep(_contexts(seeds.drop("seed").unionByName(free)), "contexts")
    edges = scratch.keep(spans.groupBy("pattern", "kind", "value").agg(F.count("*").alias("n")), "edges")
    patterns = believe(edges, scratch)
    best = patterns.groupBy("pattern", "all").agg(F.max(F.struct("score", "as")).alias("best"))
    reached = attach(spans.filter("kind = ''"), scratch.keep(best, "best"), ["pattern"], "all", F.col("row"))
    reached = reached.withColumn("as", F.col("best.as")).filter(_shape(F.col("as"), F.col("value")))
    extra = reached.groupBy("row", "start", "end", "value").agg(F.max("best").alias("best")).select("row", F.col("best.as").alias("kind"), "start", "end", "value", F.lit(False).alias("seed"))
    return source.select("row", "doc_id"), seeds.drop("last", "second").unionByName(extra)


def op4(spark, sf_dir: str) -> DataFrame:
    rows, spans = discover(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = spans.withColumn("span", F.struct("start", place.alias("place"), F.concat_ws(":", "kind", "start", "end").alias("text"), "seed"))
    joined = spans.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"), *[F.count_if((F.col("kind") == k) & F.col("seed")).alias(f"n_{k}") for k in KINDS])
    base = F.coalesce(F.array_join(F.transform(F.filter("spans", lambda s: s["seed"]), lambda s: s["text"]), ","), F.lit(""))
    every = F.coalesce(F.array_join(F.transform("spans", lambda s: s["text"]), ","), F.lit(""))
    return rows.join(joined, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))
