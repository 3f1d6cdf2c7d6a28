r"""Personal data by candidate gradient boosting, in Spark SQL functions only.

Base spans come from fixed patterns with checks (see ``BASE``). Beside them,
generators of high recall propose spans that the patterns miss: obfuscated
addresses, numbers with other separators. Boosted trees judge each candidate by
its format and its context, and a threshold per kind, calibrated on held-out
candidates to a target precision, selects the ones to add. Base spans always
stay.

Training rows are weak labels of the spans of all documents: base spans as
they are and rewritten the way people disguise them are positive; candidates
that touch no base span, and base spans broken so that the checks fail, are
negative. Equal ones (kind, features, label) are one row with their number as
its weight, summed in the tasks first, so that the table stays far smaller than
the documents. The trees are trained by Spark ML and then written out as one SQL
expression, so scoring runs inside the scan, per document, without a shuffle or
a join: a text's spans never leave its row.

The patterns are the plain ones made safe for very long texts: possessive
repetition and look-behinds keep matching linear and free of recursion, and
find the same spans.

Defined cases: a null text counts as empty; a text without spans gives an empty
list; positions count code points; tables without any base span train nothing
and add nothing. Columns of the caller keep their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingua_spark.llm.common import stage

KINDS = ["email", "ip", "card", "phone"]

#: Fixed patterns of the base spans. As written by hand they read
#:   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#:   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#:   card   [0-9]([\x20-]?[0-9])+             with 13 to 19 digits
#:   phone  \+[0-9][\x20().0-9-]+[0-9]
#: A run that fails as a whole would fail from any later place in it, so a match
#: only begins where a run does, or where the last match ended (\G). What can
#: begin a match is asked first, and what is before it after that, as most
#: letters of a text cannot.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}",
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Generators of further candidates.
_AT = r"\x20?(?:[\[({<]\x20?(?:at|AT|At|@)\x20?[\])}>]|@)\x20?"
_DOT = r"\x20?(?:[\[({<]\x20?(?:dot|DOT|Dot|\.)\x20?[\])}>]|\.)\x20?"
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+" + _AT + r"[A-Za-z0-9-]{1,63}+(?:" + _DOT + r"[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"[0-9](?<![0-9.][0-9])[0-9]{0,2}+(?:\x20?(?:[\[(](?:\.|dot)[\])]|[.,])\x20?[0-9]{1,3}+){3}(?![0-9])",
    "card": r"[0-9](?<![0-9]{2})(?:[\x20._/-]{0,2}+[0-9]){12,18}+(?![0-9])",
    "phone": r"(?=[(0-9])(?<![0-9+])(?:\(\x20?)?[0-9](?:[\x20()./-]{0,2}+[0-9]){8,14}+(?![0-9])",
}
#: What a text with an address must hold; few do.
HINTS = {BASE["email"]: "@", GENERATORS["email"]: r"@|[\[({<]\x20?(?:at|AT|At)"}
#: Words before a span that announce its kind.
CUES = {
    "email": r"(?i)(?:mail|contact|write|address)[^a-z]{0,3}$",
    "ip": r"(?i)(?:ip|host|server|addr(?:ess)?)[^a-z]{0,3}$",
    "card": r"(?i)(?:card|visa|account|credit|pay)[^a-z]{0,3}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|dial)[^a-z]{0,3}$",
}
CONTEXT = 24


@dataclass(frozen=True)
class Boosting:
    """``precision``: least share of true spans among held-out candidates at a
    kind's threshold; a kind that never reaches it on ``least_held_out`` of them
    adds nothing."""

    trees: int = 12
    depth: int = 3
    step: float = 0.3
    precision: float = 0.99
    least_held_out: int = 20
    seed: int = 7


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, b: a + b)


SPANS = "array<struct<start:int,end:int,hit:string>>"
_RUN = 64


def found(text: Column, pattern: str) -> Column:
    """All matches with start and end (exclusive), in order.

    Positions are sums over the gaps and matches before. They are added up in
    runs first, so that a text with very many matches stays affordable.
    """
    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
    )

    def place(p: Column) -> Column:
        sizes = F.transform(p["hits"], lambda hit, i: F.length(hit) + F.length(F.get(p["gaps"], i)))

        def in_runs(s: Column) -> Column:
            numbers = F.sequence(F.lit(0), (F.size(s) - 1).cast("int"))
            runs = F.transform(
                F.filter(numbers, lambda i: i % _RUN == 0), lambda i: total(F.slice(s, i + 1, F.lit(_RUN)))
            )
            return let(runs, lambda r: with_starts(s, F.transform(r, lambda x, i: total(F.slice(r, F.lit(1), i)))))

        def with_starts(s: Column, before: Column) -> Column:
            return let(
                before,
                lambda b: F.transform(
                    p["hits"],
                    lambda hit, i: let(
                        F.get(b, (i / _RUN).cast("int"))
                        + total(F.slice(s, ((i / _RUN).cast("int") * _RUN + 1).cast("int"), i % _RUN))
                        + F.length(F.get(p["gaps"], i)),
                        lambda start: F.struct(
                            start.cast("int").alias("start"),
                            (start + F.length(hit)).cast("int").alias("end"),
                            hit.alias("hit"),
                        ),
                    ),
                ),
            )

        return let(sizes, in_runs)

    holds = text.rlike(HINTS[pattern]) & text.rlike(pattern) if pattern in HINTS else text.rlike(pattern)
    return F.when(holds, let(parts, place)).otherwise(F.array().cast(SPANS))


def digits(column: Column) -> Column:
    return F.regexp_replace(column, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the checksum."""

    def digit(i: Column) -> Column:
        plain = F.ascii(F.substring(number, F.length(number) - i, F.lit(1))) - 48
        doubled = F.when(plain > 4, plain * 2 - 9).otherwise(plain * 2)
        return F.when(i % 2 == 1, doubled).otherwise(plain)

    places = F.sequence(F.lit(0), F.length(number) - 1)
    return F.aggregate(places, F.lit(0), lambda a, i: a + digit(i)) % 10 == 0


def bytes_each(address: Column) -> Column:
    """Whether all dotted parts are at most 255, however long they are."""
    parts = F.transform(F.split(address, r"\.", -1), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return bytes_each(hit)
    if kind == "card":
        return luhn(digits(hit))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(found(text, BASE[kind]), lambda s: passes(kind, s["hit"]))


# Candidates and their features

#: What the trees see of a candidate.
FEATURES = [
    "kind", "length", "digits", "letters", "separators", "groups", "longest", "brackets", "blanks", "dots",
    "at_sign", "checksum", "parts_fit", "cue", "before", "after", "prefix",
]


def char_class(c: Column) -> Column:
    """0 none, 1 white space, 2 letter, 3 digit, 4 closing sign, 5 other."""
    return (
        F.when(c == "", 0.0)
        .when(c.rlike(r"^\s"), 1.0)
        .when(c.rlike(r"^\p{L}"), 2.0)
        .when(c.rlike("^[0-9]"), 3.0)
        .when(c.rlike(r"^[.,;:!?)\]]"), 4.0)
        .otherwise(5.0)
    )


def features(kind: str, hit: Column, left: Column, right: Column) -> Column:
    """``array<double>`` in the order of FEATURES."""
    number = digits(hit)
    dotted = F.regexp_replace(hit, r"[^0-9]+", ".")
    count = lambda pattern: F.length(F.regexp_replace(hit, pattern, ""))
    groups = F.split(F.regexp_replace(hit, r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", ""), r"[^0-9A-Za-z]+", -1)
    values = [
        F.lit(KINDS.index(kind)),
        F.length(hit),
        F.length(number),
        count("[^A-Za-z]"),
        count("[0-9A-Za-z]"),
        F.size(groups),
        F.array_max(F.transform(groups, lambda g: F.length(g))),
        count(r"[^\[\](){}<>]"),
        count(r"[^\x20]"),
        count(r"[^.]"),
        count("[^@]"),
        F.when(F.length(number).between(13, 19), luhn(number).cast("int")).otherwise(0) if kind == "card" else F.lit(0),
        bytes_each(dotted).cast("int") if kind == "ip" else F.lit(0),
        left.rlike(CUES[kind]).cast("int"),
        char_class(F.right(left, F.lit(1))),
        char_class(F.left(right, F.lit(1))),
        F.when(hit.startswith("+"), 2).when(hit.startswith("00"), 1).otherwise(0),
    ]
    return F.array(*[v.cast("double") for v in values])


def with_context(text: Column, spans: Column) -> Column:
    """Spans with the letters around them."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["hit"].alias("hit"),
            F.substring(text, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT))).alias("left"),
            F.substring(text, s["end"] + 1, F.lit(CONTEXT)).alias("right"),
        ),
    )


def candidates(text: Column, kind: str, taken: Column) -> Column:
    """Generated spans of a kind that touch no base span of any kind."""
    free = F.filter(
        found(text, GENERATORS[kind]),
        lambda c: ~F.exists(taken, lambda t: (t["start"] < c["end"]) & (c["start"] < t["end"])),
    )
    return with_context(text, free)


def disguised(kind: str, hit: Column, draw: Column) -> Column:
    """The span as someone would write it to hide it."""
    if kind == "email":
        at = F.when(draw % 3 == 0, " [at] ").when(draw % 3 == 1, "(at)").otherwise(" @ ")
        dot = F.when(draw % 2 == 0, ".").otherwise(" [dot] ")
        name, host = F.split_part(hit, F.lit("@"), F.lit(1)), F.split_part(hit, F.lit("@"), F.lit(2))
        return F.concat(name, at, F.replace(host, F.lit("."), dot))
    if kind == "ip":
        return F.replace(hit, F.lit("."), F.when(draw % 2 == 0, "[.]").otherwise(" . "))
    if kind == "card":
        sign = F.when(draw % 2 == 0, ".").otherwise("/")
        return F.concat_ws("", *[F.concat(F.substring(digits(hit), 4 * i + 1, 4), F.when(F.length(digits(hit)) > 4 * i + 4, sign).otherwise("")) for i in range(5)])
    return F.when(draw % 2 == 0, F.concat(F.lit("00"), F.substring(hit, 2, 60))).otherwise(F.substring(hit, 2, 60))


def broken(kind: str, hit: Column, draw: Column) -> Column:
    """Something of the same look that is no personal data."""
    if kind == "email":
        return F.concat(F.split_part(hit, F.lit("@"), F.lit(1)), F.when(draw % 2 == 0, " @ ").otherwise("@ "), F.lit("a."), F.split_part(hit, F.lit("@"), F.lit(1)))
    if kind == "ip":
        return F.concat(F.lit("3"), F.replace(hit, F.lit("."), F.when(draw % 2 == 0, F.lit(".9")).otherwise(F.lit(",4"))))
    if kind == "card":
        last = (F.ascii(F.right(hit, F.lit(1))) - 47) % 10
        return F.concat(F.substring(digits(hit), F.lit(1), F.length(digits(hit)) - 1), last.cast("string"))
    return F.reverse(F.substring(F.concat(digits(hit), digits(hit)), F.lit(1), F.lit(9) + (draw % 7).cast("int")))


def marks(text: Column) -> Column:
    """Base spans and candidates of a text with their context, each pattern
    searched once: array of (kind, base, s)."""

    def of_kind(kind: str, base: Column, taken: Column) -> Column:
        marked = [(with_context(text, base[kind]), True), (candidates(text, kind, taken), False)]
        return F.concat(
            *[
                F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(is_base).alias("base"), s.alias("s")))
                for spans, is_base in marked
            ]
        )

    return let(
        F.struct(*[base_spans(text, k).alias(k) for k in KINDS]),
        lambda base: let(
            F.concat(*[base[k] for k in KINDS]),
            lambda taken: F.concat(*[of_kind(k, base, taken) for k in KINDS]),
        ),
    )


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """kind, features, label, half (0 to train, 1 to calibrate) and number ``n``
    of the candidates of all documents. The texts are read once; their spans
    with context are staged."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = stage(texts.select(F.explode(marks(F.col("text"))).alias("m")).select("m.*"), "pii_spans")
    rows = None
    for kind in KINDS:
        true = spans.filter((F.col("kind") == kind) & F.col("base")).select("s")
        number = F.pmod(F.xxhash64("s"), F.lit(1000))
        seen = true.select(
            F.explode(
                F.array(
                    F.struct(F.col("s.hit").alias("hit"), F.lit(1.0).alias("label")),
                    F.struct(disguised(kind, F.col("s.hit"), number).alias("hit"), F.lit(1.0).alias("label")),
                    F.struct(broken(kind, F.col("s.hit"), number).alias("hit"), F.lit(0.0).alias("label")),
                )
            ).alias("v"),
            "s.left",
            "s.right",
        ).select("v.hit", "v.label", "left", "right")
        other = spans.filter((F.col("kind") == kind) & ~F.col("base")).select(
            "s.hit", F.lit(0.0).alias("label"), "s.left", "s.right"
        )
        part = seen.unionByName(other).select(
            F.lit(kind).alias("kind"),
            F.pmod(F.xxhash64("hit", "left", "right"), F.lit(2)).cast("int").alias("half"),
            features(kind, F.col("hit"), F.col("left"), F.col("right")).alias("values"),
            "label",
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("kind", "half", "values", "label").agg(F.count("*").alias("n"))


# Boosted trees as an expression


def tree_expression(node, values: Column) -> Column:
    """A trained tree as nested CASE expressions over an array of features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    goes_left = F.element_at(values, int(split.featureIndex()) + 1) <= float(split.threshold())
    return F.when(goes_left, tree_expression(node.leftChild(), values)).otherwise(
        tree_expression(node.rightChild(), values)
    )


def probability(model: GBTClassificationModel, values: Column) -> Column:
    """The model's probability of a true span."""
    margin = F.lit(0.0)
    for tree, weight in zip(model._java_obj.trees(), model.treeWeights):
        margin = margin + tree_expression(tree.rootNode(), values) * F.lit(float(weight))
    return 1.0 / (1.0 + F.exp(margin * -2.0))


@dataclass
class Selector:
    """Trained trees and the threshold of each kind that has one."""

    model: GBTClassificationModel | None
    thresholds: dict[str, float]


def fit(docs: DataFrame, boosting: Boosting = Boosting(), text: str = "text") -> Selector:
    """Train on half of the labelled spans, calibrate on the other half."""
    rows = stage(labelled(docs, text), "pii_labelled")
    kinds = {r["label"] for r in rows.select("label").distinct().collect()}
    if len(kinds) < 2:
        return Selector(None, {})
    trainer = GBTClassifier(
        maxIter=boosting.trees, maxDepth=boosting.depth, stepSize=boosting.step, seed=boosting.seed, maxBins=32, weightCol="n"
    )
    training = rows.filter("half = 0").select(array_to_vector("values").alias("features"), "label", F.col("n").cast("double"))
    if training.select("label").distinct().count() < 2:
        return Selector(None, {})
    model = trainer.fit(training)
    scored = rows.filter("half = 1").select("kind", "label", "n", F.round(probability(model, F.col("values")), 3).alias("p"))
    bins = scored.groupBy("kind", "p").agg(F.sum(F.col("label") * F.col("n")).alias("true"), F.sum("n").alias("n")).collect()
    thresholds = {}
    for kind in KINDS:  # at most a thousand bins each
        true = n = 0
        for row in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["p"]):
            true, n = true + row["true"], n + row["n"]
            if n >= boosting.least_held_out and true >= boosting.precision * n and row["p"] > 0.5:
                thresholds[kind] = row["p"] - 0.0005
    return Selector(model, thresholds)


def with_spans(docs: DataFrame, selector: Selector, text: str = "text") -> DataFrame:
    """``docs`` as one struct column ``row`` beside ``text``, ``base`` (spans by
    kind) and ``added`` (spans by kind)."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text], F.lit("")).alias("text"))

    def added(kind: str, taken: Column) -> Column:
        if selector.model is None or kind not in selector.thresholds:
            return F.array().cast(SPANS)
        chosen = F.filter(
            candidates(F.col("text"), kind, taken),
            lambda c: let(
                features(kind, c["hit"], c["left"], c["right"]),
                lambda v: probability(selector.model, v) >= selector.thresholds[kind],
            ),
        )
        return F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["hit"].alias("hit")))

    def both(base: Column) -> Column:
        return let(
            F.concat(*[base[k] for k in KINDS]),
            lambda taken: F.struct(base.alias("base"), F.struct(*[added(k, taken).alias(k) for k in KINDS]).alias("added")),
        )

    # One expression, so that nothing is searched again for each use.
    spans = let(F.struct(*[base_spans(F.col("text"), k).alias(k) for k in KINDS]), both)
    return packed.withColumn("spans", spans).select("row", "text", "spans.base", "spans.added")


def listed(kinds: dict[str, Column]) -> Column:
    """Spans as kind:start:end, by kind as listed, then start, comma-joined."""
    def texts(kind: str, spans: Column) -> Column:
        places = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.transform(
            F.array_sort(places),
            lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")),
        )

    return F.array_join(F.concat(*[texts(kind, spans) for kind, spans in kinds.items()]), ",")


def find_pii(
    docs: DataFrame,
    boosting: Boosting = Boosting(),
    key: str = "doc_id",
    text: str = "text",
    selector: Selector | None = None,
) -> DataFrame:
    """``key`` with base counts, the digest of the base spans, and all spans.

    Trains on ``docs`` unless a ``selector`` is given.
    """
    rows = with_spans(docs, selector or fit(docs, boosting, text), text)
    base = {k: F.col(f"base.{k}") for k in KINDS}
    every = {k: F.concat(F.col(f"base.{k}"), F.col(f"added.{k}")) for k in KINDS}
    return rows.select(
        F.col("row")[key].alias(key),
        *[F.size(base[k]).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(every).alias("spans"),
    )


def redact(docs: DataFrame, boosting: Boosting = Boosting(), text: str = "text") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets.

    Of overlapping spans the earlier one's kind is shown and all their letters
    go. Null texts stay null.
    """
    rows = with_spans(docs, fit(docs, boosting, text), text)

    def of_kind(kind: str) -> Column:
        return F.transform(
            F.concat(F.col(f"base.{kind}"), F.col(f"added.{kind}")),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")),
        )

    spans = F.array_sort(F.concat(*[of_kind(kind) for kind in KINDS]))

    def pieces(s: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            return let(
                F.coalesce(F.array_max(F.transform(F.slice(s, F.lit(1), i), lambda e: e["end"])), F.lit(0)),
                lambda done: F.when(
                    x["start"] >= done,
                    F.concat(
                        F.substring(F.col("text"), done + 1, x["start"] - done),
                        F.lit("["),
                        F.upper(x["kind"]),
                        F.lit("]"),
                    ),
                ).otherwise(""),
            )

        rest = let(F.array_max(F.transform(s, lambda e: e["end"])), lambda e: F.substring(F.col("text"), e + 1, F.length("text")))
        return F.concat(F.array_join(F.transform(s, piece), ""), rest)

    rows = rows.withColumn("spans", spans).withColumn(
        "clean", F.when(F.size("spans") > 0, let(F.col("spans"), pieces)).otherwise(F.col("text"))
    )
    kept = [
        F.when(F.col("row")[c].isNotNull(), F.col("clean")).alias(c) if c == text else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return rows.select(*kept)
