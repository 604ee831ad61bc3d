"""Personal data by weak supervision: labelers vote on spans, EM weighs them and a span classifier decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, let, saved

#: Kinds that the contract's patterns give, and a kind that only the method finds: keys and tokens that a text holds in the clear.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

# Each pattern finds the same spans as the plain one of the contract, but possessively and never from inside a run, so
# that long runs of digits or letters cost linear time and no stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Broader shapes, whose spans the method may add: written-out addresses, grouped hexadecimal, digits set apart.
WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9A-Fa-f:])|\G)(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+",
    "card": r"(?:(?<![0-9])|\G)[0-9]{4}+(?:[\x20./-][0-9]{4}+){3}+(?![0-9])",
    "phone": r"(?:(?<![0-9A-Za-z+])|\G)(?:\([0-9]{2,4}+\)|[0-9]{2,4}+)(?:[\x20./-][0-9]{2,4}+){2,4}+(?![0-9])",
    "secret": r"(?:(?<![A-Za-z0-9_+/-])|\G)[A-Za-z0-9_+/-]{20,}+",
}
#: The shape of a secret that is not a word: both letters and several digits.
SECRET_SHAPE = r"^(?=.*[A-Za-z])(?:[^0-9]*[0-9]){4}"
#: Words that stand near a kind's data, and parts of the data that speak for it.
CONTEXT = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("server", "host", "address", "client", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "secret": ("token", "secret", "passw", "key", "auth", "bearer", "credential"),
}
GAZETTEER = {
    # Generic top-level domains and those of countries, private and loopback networks, issuers of cards, country codes of phones, issuers of keys.
    "email": r"(?i)\.(?:com|net|org|edu|gov|mil|int|info|biz|io|ai|app|dev|eu|ar|at|au|be|br|ca|ch|cl|cn|co|cz|de|dk|es|fi|fr|gr|hu|ie|il|in|it|jp|kr|mx|nl|no|nz|pe|pl|pt|ro|ru|se|tr|tw|ua|uk|us|za)$",
    "ip": r"^(?:10|127|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\.|^(?:fe80|fc00|fd00|2001|2a0[0-9]):",
    "card": r"^(?:4|5[1-5]|2(?:2[2-9]|[3-6]|7[01]|720)|3[47]|6(?:011|4[4-9]|5)|35(?:2[89]|[3-8])|62)",
    "phone": r"^\+?(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|00)[^0-9]?|^\(",
    "secret": r"^(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abprs]-|sk[-_]|pk[-_]|eyJ)|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$",
}
#: Code points before a span in which context words are sought.
NEAR = 24
EM_ROUNDS = 25


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The sum of digits with every second from the right doubled is a multiple of 10."""
    n = F.length(digits)

    def add(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + add(i)) % 10 == 0


def valid(kind: str, span: Column) -> Column:
    """What the contract asks of a span beyond its pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = F.transform(F.split(span, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: F.when(F.length(p) > 3, F.lit(False)).otherwise(F.substring(p, 1, 3).try_cast("int") <= 255))
    digits = _digits(span)
    n = F.length(digits)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits)).otherwise(F.lit(False))
    return n.between(10, 15)


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, span, before>> of all matches, in code points from 0, end exclusive.

    The parts between the matches give the places; before is the end of the part in front of a match.
    """
    gap = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(parts: Column) -> Column:
        def step(acc: Column, pair: Column) -> Column:
            start = acc["at"] + F.length(pair["gap"])
            end = start + F.length(pair["hit"])
            span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("span"), F.substring(pair["gap"], -NEAR, NEAR).alias("before"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        none = F.array().cast("array<struct<start:int,end:int,span:string,before:string>>")
        first = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(parts, first, step, lambda a: a["out"])

    def pairs(h: Column) -> Column:
        return F.arrays_zip(F.slice(gap, 1, F.size(h)).alias("gap"), h.alias("hit"))

    empty = F.array().cast("array<struct<start:int,end:int,span:string,before:string>>")
    return let(hits, lambda h: F.when(F.size(h) == 0, empty).otherwise(placed(pairs(h))))


def _may_hold(text: Column, kind: str) -> Column:
    """A cheap look at the whole text: without these no pattern of the kind matches."""
    if kind == "email":
        return text.contains("@") | text.contains("(at)") | text.contains("[at]")
    if kind == "secret":
        return text.rlike("[A-Za-z0-9_+/-]{20}")
    return text.rlike("[0-9]") if kind != "phone" else text.contains("+") | text.rlike("[0-9]")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, row, kind, start, end, span, base, votes...): base spans, and wide ones that touch no base span of any kind."""
    none = F.array().cast("array<struct<start:int,end:int,span:string,before:string>>")
    frame = docs
    for kind in ALL_KINDS:
        may = _may_hold(F.col("text"), kind)
        frame = frame.withColumn(f"base_{kind}", F.when(may, found(F.col("text"), BASE[kind])).otherwise(none) if kind in BASE else none)
        frame = frame.withColumn(f"wide_{kind}", F.when(may, found(F.col("text"), WIDE[kind])).otherwise(none))
    frame = frame.drop("text")
    spans = [_labelled(code, kind, base) for code, kind in enumerate(ALL_KINDS) for base in (True, False) if kind in BASE or not base]
    frame = frame.select("doc_id", "row", F.concat(*spans).alias("spans"))

    def apart(s: Column, bases: Column) -> Column:
        return ~F.exists(bases, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    chosen = let(F.filter("spans", lambda s: s["base"]), lambda bases: F.filter("spans", lambda s: s["base"] | apart(s, bases)))
    return frame.select("doc_id", "row", F.when(F.size("spans") > 0, chosen).otherwise(F.col("spans")).alias("spans"))


def _labelled(code: int, kind: str, base: bool) -> Column:
    """A kind's spans of one sort, without those that the contract drops."""

    def full(s: Column) -> Column:
        fields = [s["start"].alias("start"), s["end"].alias("end"), s["span"].alias("span"), ascii_lower(s["before"]).alias("before")]
        return F.struct(F.lit(code).alias("kind"), F.lit(base).alias("base"), *fields)

    column = F.col(f"{'base' if base else 'wide'}_{kind}")
    return F.transform(F.filter(column, lambda s: valid(kind, s["span"])) if base else column, full)


def _by_kind(cases: dict[str, Column]) -> Column:
    out = F.lit(0)
    for code, kind in enumerate(ALL_KINDS):
        out = F.when(F.col("kind") == code, cases[kind].cast("int")).otherwise(out)
    return out


def votes(spans: DataFrame) -> DataFrame:
    """Add the labelers' votes, 1 for and 0 against, and the classifier's features to rows of spans.

    Labelers: the contract's pattern and checks, the gazetteer, context words, a length that is usual, a span that stands free.
    Features of the classifier besides: shape (runs of digits and letters) and the character before.
    """
    length = F.length("span")
    digits = F.length(_digits(F.col("span")))
    usual = {"email": length.between(6, 64), "ip": length.between(7, 39), "card": digits.between(15, 16), "phone": digits.between(10, 13), "secret": length.between(24, 72)}
    shape = F.substring(F.regexp_replace(F.regexp_replace("span", "[0-9]+", "9"), "[A-Za-z]+", "a"), 1, 12)
    return spans.select(
        "*",
        _by_kind({k: F.col("base") if k in BASE else F.col("span").rlike(SECRET_SHAPE) for k in ALL_KINDS}).alias("v_pattern"),
        _by_kind({k: F.col("span").rlike(GAZETTEER[k]) for k in ALL_KINDS}).alias("v_gazetteer"),
        _by_kind({k: F.col("before").rlike("|".join(CONTEXT[k])) for k in ALL_KINDS}).alias("v_context"),
        _by_kind(usual).alias("v_length"),
        (F.col("before").rlike(r"[\s:<(='\"]$") | (F.length("before") == 0)).cast("int").alias("v_free"),
        F.md5(shape.cast("binary")).substr(1, 2).alias("f_shape"),
        F.substring("before", -1, 1).rlike("[0-9A-Za-z]").cast("string").alias("f_before"),
    )


LABELERS = ("v_pattern", "v_gazetteer", "v_context", "v_length", "v_free")
FEATURES = (*LABELERS, "f_shape", "f_before")


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> tuple[float, list[float], list[float]]:
    """Expectation-maximisation over vote patterns with counts: prior, and each labeler's rate of 1 among true and false spans.

    It starts from the pattern labeler being mostly right; rates are smoothed by one vote.
    """
    m = len(LABELERS)
    prior, hit, false = 0.5, [0.95] + [0.6] * (m - 1), [0.05] + [0.4] * (m - 1)
    total = sum(n for _, n in counts)
    for _ in range(rounds if total else 0):
        weights = [posterior(v, prior, hit, false) for v, _ in counts]
        real = sum(w * n for w, (_, n) in zip(weights, counts, strict=True))
        prior = (real + 1) / (total + 2)
        hit = [(sum(w * n * v[j] for w, (v, n) in zip(weights, counts, strict=True)) + 1) / (real + 2) for j in range(m)]
        false = [(sum((1 - w) * n * v[j] for w, (v, n) in zip(weights, counts, strict=True)) + 1) / (total - real + 2) for j in range(m)]
        # The contract's own spans are personal data whatever the others say.
        hit[0] = max(hit[0], 0.5)
        false[0] = min(false[0], 0.2)
    return prior, hit, false


def posterior(vote: tuple[int, ...], prior: float, hit: list[float], false: list[float]) -> float:
    z = math.log(prior / (1 - prior))
    for v, h, f in zip(vote, hit, false, strict=True):
        z += math.log(h / f) if v else math.log((1 - h) / (1 - f))
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text.

    Candidate spans get the labelers' votes; EM turns the counts of vote patterns (2 ** 5 per kind at most) to reliabilities and so
    to soft labels; a naive Bayes classifier over the span's features is trained on these by one aggregation (a bounded number of
    feature values) and decides on the spans that the contract's patterns don't give. Those that they give always stay.

    Returns doc_id, n_email, n_ip, n_card, n_phone (contract's spans), base_sha256 and spans (all: kind:start:end by start, then kind, joined by commas;
    those of kind secret are the method's alone), n_added and n_spans.
    Decided cases: null and empty texts have no spans; rows that repeat are searched each; nothing depends on other columns; an added
    span never overlaps one of the contract's, and added spans of different kinds may overlap; an empty table gives no rows.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("row"))
    held = saved(candidates(texts), "pii-spans")
    rows = votes(held.select(F.explode("spans").alias("s")).select("s.*"))
    votes_of = rows.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()  # 5 * 2 ** 5 rows at most
    soft = {}
    for code in range(len(ALL_KINDS)):
        counts = [(tuple(r[v] for v in LABELERS), r["n"]) for r in votes_of if r["kind"] == code]
        fitted = reliabilities(counts)
        soft |= {(code, *v): posterior(v, *fitted) for v, _ in counts}

    # Soft labels by vote pattern, then one aggregation of weights for every kind and feature value.
    label = _lookup(["kind", *LABELERS], soft, 0.0)
    weighed = rows.withColumn("p", label)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in FEATURES]))
    sums = weighed.select("kind", "p", pairs.alias("x")).groupBy("kind", "x.f", "x.v").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()  # 5 * (2 * 6 + 256) rows at most
    whole: dict[int, list[float]] = {}
    for r in sums:
        if r["f"] == FEATURES[0]:
            t = whole.setdefault(r["kind"], [0.0, 0.0])
            t[0] += r["yes"]
            t[1] += r["no"]
    odds = {(r["kind"], r["f"], r["v"]): math.log((r["yes"] + 0.5) / (whole[r["kind"]][0] + 1)) - math.log((r["no"] + 0.5) / (whole[r["kind"]][1] + 1)) for r in sums}
    bias = {(k,): math.log((yes + 1) / (no + 1)) for k, (yes, no) in whole.items()}

    def score() -> Column:
        out = _lookup(["kind"], bias, 0.0)
        for f in FEATURES:
            out = out + _lookup(["kind", f], {(k, v): w for (k, g, v), w in odds.items() if g == f}, 0.0)
        return out

    # Only wide spans are in question: few rows, which find their document again by its candidates' row number.
    numbered = saved(held.withColumn("row", F.monotonically_increasing_id()), "pii-rows")
    asked = votes(numbered.select("row", F.explode("spans").alias("s")).select("row", "s.*").where("NOT base"))
    added = asked.where(score() > 0).groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    out = numbered.join(added, F.col("row") == F.col("of"), "left")

    def told(spans: Column) -> Column:
        name = F.array(*map(F.lit, ALL_KINDS))
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.transform(F.filter("spans", lambda s: s["base"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = out.select("doc_id", base.alias("b"), F.coalesce("added", none).alias("added"))
    count = lambda k: F.size(F.filter("b", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(told(F.col("b")), 256).alias("base_sha256"),
        told(F.concat("b", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("b") + F.size("added")).cast("long").alias("n_spans"),
    )


def _lookup(keys: list[str], values: dict[tuple, float], default: float) -> Column:
    """The value of a row's keys in a small table, as a map literal."""
    if not values:
        return F.lit(default)
    entries = [x for k, v in values.items() for x in (F.lit("|".join(map(str, k))), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*entries), F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), F.lit(default))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir).select("doc_id", "text"))
