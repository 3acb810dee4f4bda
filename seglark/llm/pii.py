"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail and IP addresses, card and phone numbers.  These are
the seeds.  The words around a seed form lexical patterns ("word word _",
"word _ word"); everything that looks like an identifier in such a context is
an instance of the pattern.  Patterns and instances form a graph that is scored
in rounds: a pattern is as good as the share of its instances that are known,
an instance as good as its patterns make it.  Instances of patterns with high
confidence are added to the seeds' kind.

DataFrame functions only.  Texts are scanned where they are read; only spans
with their contexts, which are few, are shuffled, and pattern counts are
aggregated before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

KINDS = ("email", "ip", "card", "phone")
#: The base patterns; possessive, which finds the same spans and takes no stack for long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a span of the kind to pass: most texts stop here.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){12}", "phone": "+"}
#: What may begin an identifier-like token: letters and digits with joining marks that hold two digits, a joining "@" or "-at-".
#: Leading marks are part of the match, so that no run is looked through twice; trailing ones are not.
CANDIDATE = (
    r"(?<![A-Za-z0-9@._%+-])[@._%+-]*+"
    r"(?=[A-Za-z@._%+-]*+[0-9][A-Za-z@._%+-]*+[0-9]|[A-Za-z0-9._%+-]++@[@._%+-]*+[A-Za-z0-9]|[A-Za-z0-9@._%+-]+?-[Aa][Tt]-[A-Za-z0-9])"
    r"[A-Za-z0-9]++(?:[@._%+-]++[A-Za-z0-9]++)*+"
)
#: What a text must hold for a candidate.
CANDIDATE_NEEDS = r"[0-9@]|-[Aa][Tt]-"
#: Symbols of a candidate at least.
LEAST = 4
ROUNDS, MIN_SEEDS, CONFIDENCE, SMOOTH = 3, 3, 0.8, 0.5
#: Symbols beside a span that are looked at first; further ones only where these don't hold whole words enough.
NEAR = (80, 800)
BLOCK = 256


def running_sums(values: Column) -> Column:
    """Sums of all prefixes of an array; appends to short blocks, so that long arrays stay cheap."""
    none = F.array().cast("array<int>")

    def sums(v: Column) -> Column:
        return F.aggregate(v, none, lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x)))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: sums(F.slice(v, b * BLOCK + 1, BLOCK)))

        def add(own: Column) -> Column:
            totals = sums(F.transform(own, lambda b: F.element_at(b, -1)))
            return F.flatten(F.zip_with(own, totals, lambda b, t: F.transform(b, lambda x: x + t - F.element_at(b, -1))))

        return let(blocks, add)

    return let(values, lambda v: F.when(F.size(v) == 0, none).otherwise(whole(v)))


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs of start, end (code points, exclusive) and value."""
    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def place(p: Column) -> Column:
        sizes = F.zip_with(F.slice(p["g"], 1, F.size(p["m"])), p["m"], lambda g, m: F.length(g) + F.length(m))
        ends = running_sums(sizes)
        return let(ends, lambda e: F.zip_with(p["m"], e, lambda m, x: F.struct((x - F.length(m)).alias("start"), x.alias("end"), m.alias("value"))))

    return let(pair, place)


_SPANS = "array<struct<start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 2) | p.rlike("^(?:1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The spans of one kind that pass its test, in order."""
    needs = F.contains(text, F.lit(NEEDS[kind])) if len(NEEDS[kind]) == 1 else text.rlike(NEEDS[kind])
    found = F.filter(located(text, PATTERNS[kind]), lambda s: _holds(kind, s["value"]))
    return F.when(needs, found).otherwise(F.array().cast(_SPANS))


def _bare(spans: Column) -> Column:
    """Candidates without their leading marks, where enough is left."""
    bare = F.transform(spans, lambda s: F.struct(s["end"].alias("end"), F.regexp_replace(s["value"], "^[@._%+-]++", "").alias("value")))
    return F.transform(F.filter(bare, lambda s: F.length(s["value"]) >= LEAST), lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def with_base(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    own = docs.select(docs["doc_id"].alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), *more)
    return own.select("*", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])


def instances(docs: DataFrame) -> DataFrame:
    """One row per seed or candidate: ``doc_id, text_hash, kind`` (null: candidate), ``start, end, value, patterns``."""
    own = with_base(docs)
    found = F.when(F.col("text").rlike(CANDIDATE_NEEDS), _bare(located(F.col("text"), CANDIDATE))).otherwise(F.array().cast(_SPANS))
    own = own.select("*", found.alias("c")).filter(F.size("c") + sum((F.size(k) for k in KINDS), F.lit(0)) > 0)
    taken = F.concat(*KINDS)
    free = let(taken, lambda t: F.filter("c", lambda c: ~F.exists(t, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))

    def tagged(spans: Column, kind: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    every = F.concat(*[tagged(F.col(k), F.lit(k)) for k in KINDS], tagged(free, F.lit(None).cast("string")))
    rows = own.select("doc_id", "text_hash", "text", F.explode(every).alias("s"))
    rows = rows.select("doc_id", "text_hash", "s.*", before_span(F.col("text"), F.col("s.start")).alias("left"), after_span(F.col("text"), F.col("s.end")).alias("after"))
    patterns = F.array(
        F.when(F.col("left.a") != "", F.concat("left.a", F.lit(" "), "left.b", F.lit(" _"))),
        F.when((F.col("left.b") != "") & (F.col("after") != ""), F.concat("left.b", F.lit(" _ "), "after")),
    )
    return rows.select("doc_id", "text_hash", "kind", "start", "end", "value", F.filter(patterns, lambda p: p.isNotNull()).alias("patterns"))


def before_span(text: Column, start: Column) -> Column:
    """The last two words (runs of letters) ``a`` and ``b`` before place ``start``, lower-cased; empty where there is none."""

    def within(size: Column) -> Column:
        own = F.substring(text, start - size + 1, size)
        # a word that begins with the piece may have begun before it
        two = F.regexp_extract(own, r"(\p{L}+)[^\p{L}]+\p{L}+[^\p{L}]*$", 1)
        return F.struct(F.lower(two).alias("a"), F.lower(F.regexp_extract(own, r"(\p{L}+)[^\p{L}]*$", 1)).alias("b"), own.rlike(r"\P{L}\p{L}+[^\p{L}]+\p{L}+[^\p{L}]*$").alias("whole"))

    return _nearest(start, within, lambda x: x)


def after_span(text: Column, end: Column) -> Column:
    """The first word after place ``end``, lower-cased; empty where there is none."""

    def within(size: Column) -> Column:
        own = F.substring(text, end + 1, size)
        return F.struct(F.lower(F.regexp_extract(own, r"^[^\p{L}]*(\p{L}+)", 1)).alias("w"), own.rlike(r"^[^\p{L}]*\p{L}+\P{L}").alias("whole"))

    return _nearest(F.length(text) - end, within, lambda x: x["w"])


def _nearest(size: Column, within, value) -> Column:
    """``value(within(n))`` for the least n of ``NEAR`` whose answer is whole, or for all of ``size``."""

    def tiers(left: tuple[int, ...]) -> Column:
        if not left:
            return value(within(size))
        wider = tiers(left[1:])
        return F.when(size > left[0], let(within(F.lit(left[0])), lambda x: F.when(x["whole"], value(x)).otherwise(wider))).otherwise(value(within(size)))

    return tiers(tuple(NEAR))


def discover(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """``kind, value`` of candidates that high-confidence patterns name.

    A pattern needs ``min_seeds`` distinct seeds of a kind.  Its confidence for
    the kind is the sum of its distinct instances' scores by their number plus
    ``SMOOTH``; a candidate's score is that of its best pattern.  A candidate
    takes the kind of its best score; ties go to the kind listed first.
    """
    order = F.array(*[F.lit(k) for k in KINDS])
    edges = found.select("kind", "value", F.explode("patterns").alias("pattern")).distinct()
    # Only patterns of enough seeds matter, and only their instances.
    seeded = edges.filter("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).filter(F.col("seeds") >= min_seeds)
    seeded = seeded.select("pattern", F.col("kind").alias("of"))
    graph = cut(edges.join(seeded.select("pattern").distinct(), "pattern").join(seeded, "pattern"), "pii-graph")
    sizes = graph.groupBy("pattern", "of").agg(F.count_distinct("value").alias("n"))
    scores = None
    for _ in range(rounds):
        known = graph.withColumn("known", F.when(F.col("kind") == F.col("of"), 1.0).otherwise(0.0))
        if scores is not None:
            known = known.join(scores, ["value", "of"], "left").withColumn("known", F.when(F.col("kind").isNull(), F.coalesce("score", F.lit(0.0))).otherwise(F.col("known")))
        best = known.groupBy("pattern", "of", "value").agg(F.max("known").alias("known"))
        trust = best.groupBy("pattern", "of").agg(F.sum("known").alias("sum")).join(sizes, ["pattern", "of"])
        trust = trust.select("pattern", "of", (F.col("sum") / (F.col("n") + SMOOTH)).alias("trust"))
        scores = cut(graph.filter("kind is null").join(trust, ["pattern", "of"]).groupBy("value", "of").agg(F.max("trust").alias("score")), "pii-scores")
    first = Window.partitionBy("value").orderBy(F.desc("score"), F.array_position(order, F.col("of")))
    good = scores.filter(F.col("score") >= confidence)
    return good.withColumn("r", F.row_number().over(first)).filter("r = 1").select(F.col("of").alias("kind"), "value")


def added_spans(found: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, text_hash, added``: the spans of discovered values in each text."""
    hits = found.filter("kind is null").drop("kind", "patterns").join(known, "value")
    hits = hits.select("doc_id", "text_hash", "kind", "start", "end").distinct()
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))  # spans of one text


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, text, email, ip, card, phone`` (base spans) and ``spans``: all, by kind as listed, then start.

    Null texts count as empty; repeated rows get the same spans each; an empty
    table gives an empty result; other columns are not read.
    """
    return _every(with_base(docs), docs)


def _every(own: DataFrame, docs: DataFrame) -> DataFrame:
    """``own`` with ``spans`` in place of what :func:`with_base` adds for them."""
    found = cut(instances(docs), "pii-instances")
    # written first: where it is small enough to be broadcast, the texts needn't move for it
    added = cut(added_spans(found, discover(found)), "pii-added").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "added")
    own = own.join(added, own["doc_id"].eqNullSafe(added["d"]) & (own["text_hash"] == added["t"]), "left").drop("d", "t")
    order = F.array(*[F.lit(k) for k in KINDS])

    def ranked(spans: Column, kind=None) -> Column:
        return F.transform(spans, lambda s: F.struct((F.array_position(order, s["kind"]) if kind is None else F.lit(KINDS.index(kind) + 1).cast("long")).alias("k"), s["start"].alias("start"), s["end"].alias("end")))

    none = F.array().cast("array<struct<k:bigint,start:int,end:int>>")
    every = F.sort_array(F.concat(*[ranked(F.col(k), k) for k in KINDS], F.coalesce(ranked(F.col("added")), none)))
    return own.withColumn("spans", every).drop("added")


def _joined(spans: Column, kind: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", kind, s["start"].cast("string"), s["end"].cast("string")))


def report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    order = F.array(*[F.lit(k) for k in KINDS])
    own = detect(docs)
    base = F.array_join(F.concat(*[_joined(F.col(k), F.lit(k)) for k in KINDS]), ",")
    every = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(order, s["k"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return own.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``[KIND]`` of its first (of equals the longest)."""
    order = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    sorted_ = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["k"].alias("k"))))

    def write(s: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

        def step(a: Column, x: Column) -> Column:
            before = F.substring(text, a["at"] + 1, x["start"] - a["at"])
            out = F.when(x["start"] >= a["at"], F.concat(a["out"], F.array(before, F.element_at(order, x["k"].cast("int"))))).otherwise(a["out"])
            return F.struct(out.alias("out"), F.greatest(a["at"], -x["end"]).alias("at"))

        return F.aggregate(s, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))

    return F.when(F.size(spans) == 0, text).otherwise(let(sorted_, write))


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans masked in ``text``, and ``n_chars`` (if there) set to the new length.

    All rows and columns are kept; null texts stay null.
    """
    names = docs.columns
    row = F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row")
    own = _every(with_base(docs, row), docs)
    own = own.select("row", masked(F.col("text"), F.col("spans")).alias("text"))
    place = names.index("text")
    types = {c: t for c, t in docs.dtypes}
    new = F.when(F.col(f"row.c{place}").isNotNull(), F.col("text"))

    def column(i: int, c: str) -> Column:
        if c == "n_chars":
            return F.coalesce(F.length(new).cast(types[c]), F.col(f"row.c{i}"))
        return new if c == "text" else F.col(f"row.c{i}")

    return own.select(*[column(i, c).alias(c) for i, c in enumerate(names)])
