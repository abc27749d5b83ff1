"""Personal data: rule spans, candidate spans scored by boosted trees, and redaction.

Base spans of four kinds come from fixed patterns and checks and are always kept. High-recall
generators propose further, overlapping candidates (numbers with any separators, local phone
formats, spelt-out addresses). Boosted trees are fitted on a bounded sample of each kind's
candidates (equal ones are one row with their count as weight), labelled by whether they overlap a base span of their kind (an address by whether
it is one once its spelt marks are written as marks), on features of the
format (digits, groups, separators, checks) and of the context (characters and keywords
around); the leading ``+`` that decides the base rule for phones and the separators that
decide the one for IP addresses are not among them, so the trees carry over to formats the rules miss. Thresholds per kind are calibrated on all held-out
candidates (a third, by hash) to a given precision. Everything runs as column expressions: the trees
become CASE expressions, and each document is read once.

Cases: a null or empty text has no spans; long texts are searched whole; possessive
quantifiers keep the patterns linear on long runs; equal rows get equal results each; an
empty table gives no rows; candidates of one label only all score that label; a null id
is carried as null; further columns, whatever their names, are kept by ``redact`` and ignored otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafcast.functions import arrays
from leafcast.session import materialize

KINDS = ("email", "ip", "card", "phone")

# The base patterns, with possessive quantifiers where they match the same.
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": "+"}

# The generators of candidates.
NUMBER = r"(?<![0-9])\(?[0-9](?:[\x20().\-/]{0,2}[0-9])++"
LOCAL_PHONE = r"(?<![0-9])\(?[0-9]{3}\)?[\x20.\-][0-9]{3}[\x20.\-][0-9]{4}(?![0-9])"
SPELT = (
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++"
    r"(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++"
)
SPELT_AT = r"(?i)\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?"
SPELT_DOT = r"(?i)\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?"
NUMBER_HINT = r"[0-9](?:[\x20().\-/]{0,2}[0-9]){6}"
SPELT_HINT = r"(?i)[(\[\x20]dot[)\]\x20]"
KEYWORDS = {"mail": r"mail|contact|write", "tel": r"tel|phone|call|fax|mobile", "card": r"card|visa|credit|pay", "ip": r"ip\b|host|server|address"}
CONTEXT = 24

FEATURES = (
    "kind_no", "n_chars", "n_digits", "n_groups", "first_group", "last_group", "longest_group", "n_spaces", "n_hyphens", "n_dots",
    "n_slashes", "n_parens", "luhn", "octets", "spelt", "before", *(f"near_{k}" for k in KEYWORDS),
)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    def term(c: Column, i: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0))
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    doubled = F.transform(F.split(F.reverse(digits), "(?!^)"), term)
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return (F.length(digits) > 0) & (total % 10 == 0)


def octets(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(F.substring(bare, 1, 3).try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(value, r"\."), small)


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits_of(value))
    return {
        "email": F.lit(True),
        "ip": octets(value),
        "card": n.between(12, 19) & luhn(digits_of(value)),
        "phone": n.between(9, 15),
    }[kind]


def _parts(text: Column, pattern: str, hint: Column) -> Column:
    """Array of (gap before, hit): the hits of a pattern, each with the text between it and the one before."""
    cut = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    none = F.array(F.struct(text.alias("gap"), F.lit(None).cast("string").alias("hit")))
    return F.when(hint, cut).otherwise(none)


def _hits(parts: Column) -> Column:
    """Array of (start, end, value, left): offsets in code points, and the text before each hit."""

    def one(x: Column, at: Column) -> Column:
        start = at.cast("int") + F.length(x["gap"])
        return F.struct(
            start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("value"), F.right(x["gap"], F.lit(CONTEXT)).alias("left")
        )

    def found(ps: Column) -> Column:
        sizes = F.transform(ps, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))
        return F.filter(F.zip_with(ps, arrays.running_sums(sizes), one), lambda h: h["value"].isNotNull())

    return arrays.bound(parts, found)


def _base(text: Column) -> Column:
    def spans(no: int, kind: str) -> Column:
        hint = F.contains(text, F.lit(HINTS[kind])) if len(HINTS[kind]) == 1 else F.rlike(text, F.lit(HINTS[kind]))
        hits = F.filter(_hits(_parts(text, BASE_PATTERNS[kind], hint)), lambda h: valid(kind, h["value"]))
        return F.transform(hits, lambda h: F.struct(h["start"].alias("start"), F.lit(no).alias("kind_no"), h["end"].alias("end")))

    return F.sort_array(F.concat(*(spans(no, kind) for no, kind in enumerate(KINDS))))


def _char_class(c: Column) -> Column:
    return (
        F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0)
        .when(c.rlike(r"\s"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\p{L}"), 3).otherwise(4)
    )


def _candidates(number: Column, local: Column, spelt: Column) -> Column:
    """Array of (start, end, value, left, kind_no, spelt): the hits of the generators under the kinds they may be."""

    def of(hits: Column, kind: str, keep, is_spelt: int = 0) -> Column:
        return F.transform(
            F.filter(hits, keep),
            lambda h: F.struct(
                h["start"].alias("start"), h["end"].alias("end"), h["value"].alias("value"), h["left"].alias("left"),
                F.lit(float(KINDS.index(kind))).alias("kind_no"), F.lit(float(is_spelt)).alias("spelt"),
            ),
        )

    n_digits = lambda h: F.length(digits_of(h["value"]))
    return F.concat(
        of(spelt, "email", lambda h: F.lit(True), 1),
        of(number, "ip", lambda h: h["value"].rlike(r"^[0-9]+(?:[\x20.\-/]+[0-9]+){3}$")),
        of(number, "card", lambda h: n_digits(h).between(12, 19)),
        of(number, "phone", lambda h: n_digits(h).between(7, 15)),
        of(local, "phone", lambda h: F.lit(True)),
    )


def _features(h: Column) -> Column:
    """Span, a hash that spreads candidates, and the features of one candidate."""
    value, left, kind = h["value"], h["left"], h["kind_no"]
    digits = digits_of(value)
    is_ip = kind == KINDS.index("ip")
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    count = lambda c: (F.length(value) - F.length(F.replace(value, F.lit(c), F.lit("")))).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("double")
    row = {
        "kind_no": kind,
        "n_chars": F.length(value).cast("double"),
        "n_digits": F.length(digits).cast("double"),
        "n_groups": F.size(groups).cast("double"),
        "first_group": size(F.get(groups, F.lit(0))),
        "last_group": size(F.try_element_at(groups, F.lit(-1))),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
        "n_spaces": count(" "), "n_hyphens": count("-"), "n_dots": count("."), "n_slashes": count("/"),
        "n_parens": count("(") + count(")"),
        "luhn": F.when(kind == KINDS.index("card"), flag(luhn(digits))).otherwise(0.0),
        "octets": F.when(is_ip, flag(octets(F.regexp_replace(value, "[^0-9]+", ".")))).otherwise(0.0),
        "spelt": h["spelt"],
        # A plus sign before the number decides the base rule for phones, so it is not shown to the trees.
        "before": _char_class(F.right(F.regexp_replace(left, r"\+[0-9]*\x20?$", " "), F.lit(1))).cast("double"),
    }
    # Nor are the separators of what may be an IP address.
    row |= {k: F.when(is_ip, 0.0).otherwise(row[k]) for k in ("n_chars", "n_spaces", "n_hyphens", "n_dots", "n_slashes")}
    row |= {f"near_{k}": flag(F.lower(left).rlike(p)) for k, p in KEYWORDS.items()}
    overlap = _meets(F.get("pii_index", kind.cast("int")), h)
    plain = F.regexp_replace(F.regexp_replace(value, SPELT_AT, "@"), SPELT_DOT, ".")
    # No base span holds spelt marks, so an address is labelled on its plain form.
    label = (overlap | ((kind == KINDS.index("email")) & plain.rlike(f"^(?:{BASE_PATTERNS['email']})$"))).cast("double")
    return F.struct(
        h["start"].alias("start"), h["end"].alias("end"), F.xxhash64(value, left, h["start"]).alias("h"),
        *(row[f].alias(f) for f in FEATURES), label.alias("label"),
    )


def _index(base: Column) -> Column:
    """Per kind the starts and the ends of its base spans, both in order as the spans of a kind do not overlap."""

    def of(no: int) -> Column:
        own = F.filter(base, lambda b: b["kind_no"] == no)
        return arrays.bound(own, lambda spans: F.struct(F.transform(spans, lambda b: b["start"]).alias("starts"), F.transform(spans, lambda b: b["end"]).alias("ends")))

    return F.array(*(of(no) for no in range(len(KINDS))))


def _meets(own: Column, c: Column) -> Column:
    """Whether a candidate overlaps a base span of one kind: more begin before its end than end by its start."""
    return arrays.n_below(own["starts"], c["end"]) > arrays.n_below(own["ends"], c["start"] + 1)


def find_candidates(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column pii_text) with ``pii_base``, ``pii_index`` and ``pii_candidates`` (labelled by overlap with the first)."""
    text = F.coalesce("pii_text", F.lit(""))
    digits = F.rlike(text, F.lit(NUMBER_HINT))
    out = rows.withColumns({
        "pii_base": _base(text),
        "pii_number": _hits(_parts(text, NUMBER, digits)),
        "pii_local": _hits(_parts(text, LOCAL_PHONE, digits)),
        "pii_spelt": _hits(_parts(text, SPELT, F.rlike(text, F.lit(SPELT_HINT)))),
    })
    found = out.withColumn("pii_index", _index(F.col("pii_base")))
    found = found.withColumn("pii_candidates", _candidates(F.col("pii_number"), F.col("pii_local"), F.col("pii_spelt")))
    return found.withColumn("pii_candidates", F.transform("pii_candidates", _features)).drop("pii_number", "pii_local", "pii_spelt")


def _tree(node, features) -> Column:
    """CASE expression of one fitted tree."""
    if node.subtreeDepth() == 0:
        return F.lit(node.prediction())
    split = node.split()
    return F.when(features[FEATURES[split.featureIndex()]] <= split.threshold(), _tree(node.leftChild(), features)).otherwise(
        _tree(node.rightChild(), features)
    )


def fit(found: DataFrame, sample_rows: int = 20_000, precision: float = 0.9, rounds: int = 10, depth: int = 3):
    """(score of a candidate struct as a Column function, threshold per kind).

    ``sample_rows`` bounds the distinct candidates fitted on: an equal part for each kind, those with the smallest
    hashes. A third of all candidates is held out from it; a kind's threshold is the lowest score whose isotonic share of
    positives among all its held-out candidates reaches ``precision``.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = found.select(F.explode("pii_candidates").alias("c")).select("c.*")
    seen = rows.where(F.pmod("h", F.lit(3)) != 1).groupBy("h", *FEATURES, "label").agg(F.count("*").cast("double").alias("n"))
    seen = materialize(seen, "pii-distinct")
    each = max(sample_rows // len(KINDS), 1)
    parts = (seen.where(F.col("kind_no") == no).orderBy("h", *FEATURES, "label").limit(each) for no in range(len(KINDS)))
    train = materialize(reduce(DataFrame.union, parts), "pii-sample")
    labels = [r["label"] for r in train.select("label").distinct().collect()]
    if len(labels) < 2:
        score = lambda c: F.lit(labels[0] if labels else 0.0)
        return score, _limits(rows, score, precision)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train).select("features", "label", "n")
    model = GBTClassifier(weightCol="n", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False).fit(table.coalesce(4))
    roots = [(w, t._call_java("rootNode")) for w, t in zip(model.treeWeights, model.trees, strict=True)]

    def score(c: Column) -> Column:
        margin = reduce(lambda a, b: a + b, (_tree(root, c) * F.lit(float(w)) for w, root in roots))
        return 1 / (1 + F.exp(-2 * margin))

    return score, _limits(rows, score, precision)


def _limits(rows: DataFrame, score, precision: float) -> dict[int, float]:
    """Threshold per kind, calibrated on its held-out candidates; on all of them if it has no held-out one."""
    bins = (
        rows.withColumn("c", F.struct(*FEATURES))
        .select("kind_no", "label", (F.pmod("h", F.lit(3)) == 1).alias("held"), F.floor(score(F.col("c")) * 1000).cast("int").alias("bin"))
        .groupBy("kind_no", "held", "bin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    )  # at most 1,001 bins for each of the four kinds, held out or not
    limits = {}
    for no in range(len(KINDS)):
        own = [r for r in bins if r["kind_no"] == no]
        level = calibrated([(r["bin"], r["good"], r["n"]) for r in [r for r in own if r["held"]] or own])
        over = [b for b, p in level.items() if p >= precision]
        if over:
            limits[no] = min(over) / 1000
    return limits


def calibrated(bins: list[tuple[int, float, int]]) -> dict[int, float]:
    """Isotonic share of good cases per score bin: never falling with the score, neighbours that would are pooled."""
    pools: list[list] = []
    for b, good, n in sorted(bins):
        pools.append([[b], good, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            names, more, count = pools.pop()
            pools[-1] = [pools[-1][0] + names, pools[-1][1] + more, pools[-1][2] + count]
    return {b: good / n for names, good, n in pools for b in names}


def _chosen(model) -> Column:
    """Candidates over their kind's threshold, clear of base spans, the best of those that overlap; as (start, kind_no, end)."""
    score, limits = model
    limit = F.lit(2.0)
    scored = F.transform(
        "pii_candidates", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind_no"].cast("int").alias("kind_no"), score(c).alias("score"))
    )

    def over(c: Column) -> Column:
        bound = limit
        for no, at in limits.items():
            bound = F.when(c["kind_no"] == no, at).otherwise(bound)
        return (c["score"] >= bound) & ~F.exists("pii_index", lambda own: _meets(own, c))

    return F.filter(scored, over)


def _rank(c: Column) -> Column:
    return F.struct(c["score"], -c["start"], c["end"], -c["kind_no"])


def _best(over: Column) -> Column:
    """Candidates that no overlapping one outranks; in order of start, each is compared with its neighbours alone."""

    def of(cs: Column) -> Column:
        starts, ends = F.transform(cs, lambda c: c["start"]), F.transform(cs, lambda c: c["end"])
        # The furthest end up to each place never falls, so both edges of the neighbours are found by halving.
        reach = arrays.bound(ends, lambda e: F.zip_with(e, arrays.running(e, F.lit(0), F.greatest, "int"), lambda a, b: F.greatest(a, b)))
        order = F.struct(cs.alias("cs"), starts.alias("starts"), reach.alias("reach"))

        def best(o: Column) -> Column:
            def stays(c: Column) -> Column:
                first = arrays.n_below(o["reach"], c["start"] + 1)
                near = F.slice(o["cs"], first + 1, F.greatest(arrays.n_below(o["starts"], c["end"]) - first, F.lit(0)))
                return ~F.exists(near, lambda d: (d["start"] < c["end"]) & (c["start"] < d["end"]) & (_rank(d) > _rank(c)))

            return F.filter(o["cs"], stays)

        return arrays.bound(order, best)

    return arrays.bound(F.array_sort(over), of)


def _distinct(ordered: Column) -> Column:
    """An array in order without repeats."""
    return arrays.bound(ordered, lambda a: F.filter(a, lambda x, i: (i == 0) | ~F.get(a, i - 1).eqNullSafe(x)))


def _spans(rows: DataFrame, carried: str, sample_rows: int, precision: float) -> DataFrame:
    """``carried``, ``base_spans`` and ``spans`` of rows with a column pii_text."""
    found = materialize(find_candidates(rows).select(carried, "pii_base", "pii_index", "pii_candidates"), "pii-found")
    model = fit(found.select("pii_candidates"), sample_rows, precision)
    out = found.withColumn("pii_over", _chosen(model))
    best = _best(F.col("pii_over"))
    out = out.withColumn("pii_over", F.transform(best, lambda c: F.struct(c["start"], c["kind_no"], c["end"])))
    spans = _distinct(F.array_sort(F.concat("pii_base", "pii_over")))
    return out.select(carried, F.col("pii_base").alias("base_spans"), spans.alias("spans"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 20_000, precision: float = 0.9) -> DataFrame:
    """One row per document: doc_id, ``base_spans`` and ``spans``: arrays of (start, kind_no, end) by start and kind, in code points.

    ``spans`` holds the base spans and those the trees add.
    """
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("pii_text"))
    return _spans(rows, "doc_id", sample_rows, precision)


def redacted(text: Column, spans: Column) -> Column:
    """Text with every span (start, kind_no, end) replaced by its kind in angle brackets; an overlap keeps the earlier one's name."""
    kinds = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def of(x: Column) -> Column:
        ends = F.transform(x["spans"], lambda s: s["end"])
        past = arrays.running(ends, F.lit(0), F.greatest, "int")  # how far the spans before each one reach

        def piece(s: Column, at: Column) -> Column:
            return F.when(s["start"] >= at, F.concat(arrays.cut_from(x["pieces"], at, s["start"]), F.get(kinds, s["kind_no"]))).otherwise("")

        rest = arrays.cut_from(x["pieces"], F.coalesce(F.array_max(ends), F.lit(0)), F.length(text))
        return F.concat(F.array_join(F.zip_with(x["spans"], past, piece), ""), rest)

    return arrays.bound(F.struct(spans.alias("spans"), arrays.text_pieces(text).alias("pieces")), of)


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = None, sample_rows: int = 20_000, precision: float = 0.9) -> DataFrame:
    """``docs`` with the personal data of its texts replaced; same rows and columns, other texts as they were.

    ``size_col``: a column that gets the code points of the texts that were changed.
    """
    whole = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns))
    rows = docs.select(whole.alias("pii_row"), docs[text_col].cast("string").alias("pii_text"))
    out = _spans(rows, "pii_row", sample_rows, precision)
    touched = F.size("spans") > 0
    out = out.withColumn("pii_text", F.when(touched, redacted(F.col("pii_row")[text_col], F.col("spans"))))

    def column(name: str) -> Column:
        kept = F.col("pii_row")[name]
        new = {text_col: F.col("pii_text"), size_col: F.length("pii_text").cast(docs.schema[size_col].dataType) if size_col else None}
        return (F.when(touched, new[name]).otherwise(kept) if name in new else kept).alias(name)

    return out.select(*(column(c) for c in docs.columns))
