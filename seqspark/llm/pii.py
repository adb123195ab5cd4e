"""Personal data by weak supervision, in DataFrame operations only.

Fixed rules and looser patterns propose spans. Five labelers vote for or against each or abstain: the
rule, a plausibility check, a gazetteer (domains, calling codes, issuer prefixes, address blocks),
words before the span, and what touches it. Votes are counted over all documents, by kind; expectation-
maximisation over these counts estimates how reliable each labeler is, and its posteriors train the final span
classifier, a logistic regression on votes and shape. Spans of the rules stay; other proposals are
added where the classifier gives at least ``THRESHOLD`` and no span of a rule overlaps.

The counts have at most ``3**5 * 9`` rows a kind, whatever the corpus, and are fitted by one fold.

Defined results: a null text is empty; texts of any length are searched whole; offsets are code points; spans of equal
start are ordered by end; repeated rows give repeated rows, rows without an id too; an empty table gives no rows; without
proposals nothing is added; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

KINDS = ("email", "ip", "card", "phone")
LABELERS = 5
THRESHOLD = 0.9
#: Mark spans inside a text; these code points are not characters and are replaced if a text has them.
OPEN, CLOSE, SPARE = "﷐", "﷑", "�"

#: The contract's patterns with guards and possessive repeats, which match the same in linear time.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser proposals: spelt-out addresses, eight-group addresses, dotted card groups, numbers without a plus.
LOOSE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[a-z0-9-]{1,63}(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[a-z0-9-]{2,63}){1,4}(?![a-z0-9-])",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])",
}
PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[\])]?\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl|us|ca|example)$",
    "ip": r"^(?:10|127|172|192|[1-9][0-9]?|1[0-9]{2}|2[0-1][0-9]|22[0-3])\.|^(?i)(?:2[0-9a-f]{3}|fe80|fd[0-9a-f]{2}):",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?0[1-9]",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|kontakt|correo|courriel|write|address|adresse)",
    "ip": r"(?i)(?:\bip\b|\bhost|server|address|adresse|gateway)",
    "card": r"(?i)(?:card|visa|credit|karte|carte|tarjeta|payment)",
    "phone": r"(?i)(?:phone|\btel\b|\btel[.:]|call|mobile|handy|fax|telefon|tél|móvil)",
}


def _spans(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as an array of (start, end, value)."""
    pieces = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]")
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    first = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), none.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        one = F.array(F.struct(acc["at"].alias("start"), end.alias("end"), piece.alias("value")))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern.replace(r"(?:\G|", "(?:")), F.aggregate(pieces, first, step)["out"]).otherwise(none)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x))
    return F.aggregate(F.filter(twice, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """Whether a match of the kind's rule stands."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    n = F.length(_digits(value))
    return n.between(13, 19) & _luhn(_digits(value)) if kind == "card" else n.between(9, 15)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 2).when(no, 0).otherwise(1)


def _proposal(kind: str, text: Column, s: Column, rule: bool) -> Column:
    """A span with votes (0 against, 1 abstains, 2 for) and two shape classes of three values."""
    value = s["value"]
    before = F.substring(text, F.greatest(s["start"] - 39, F.lit(1)), F.least(s["start"], F.lit(40)))
    after = F.substring(text, s["end"] + 1, F.lit(1))
    base = passes(kind, value) if rule else F.lit(False)
    n = F.length(_digits(value))
    plausible = {"email": (F.length(value) >= 6, F.length(value) > 120), "ip": (F.length(value) >= 7, n == 0), "card": ((n == 16) | (n == 15), (n < 13) | (n > 19)), "phone": (n.between(9, 13), (n < 7) | (n > 15))}[kind]
    votes = [
        _vote(base, F.lit(rule) & ~base),
        _vote(_luhn(_digits(value)) & plausible[0] if kind == "card" else plausible[0], plausible[1]),
        _vote(value.rlike(GAZETTEER[kind]), F.lit(False)),
        _vote(before.rlike(CONTEXT[kind]), F.lit(False)),
        _vote(before.rlike(r"(?:^|[\s(<\[:;,=|\"'])$") & (after.rlike(r"^[\s)>\],.;:!?|\"']$") | (after == "")), before.rlike(r"[A-Za-z0-9_]$") | after.rlike(r"^[A-Za-z0-9_]")),
    ]
    separators = F.length(F.regexp_replace(value, "[0-9A-Za-z]", ""))
    shape = [F.when(separators < 2, 0).when(separators < 4, 1).otherwise(2), F.when(F.length(value) < 14, 0).when(F.length(value) < 20, 1).otherwise(2)]
    return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), base.alias("base"), F.array(*votes).alias("votes"), F.array(*shape).alias("shape"))


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): all proposals of each row; those of rules have ``base`` where they stand."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = F.replace(F.replace(text, F.lit(OPEN), F.lit(SPARE)), F.lit(CLOSE), F.lit(SPARE))
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    for kind in KINDS:
        found = found.withColumn(f"rule_{kind}", _spans(F.col("_text"), RULES[kind])).withColumn(f"loose_{kind}", _spans(F.col("_text"), LOOSE[kind]))
    made = lambda kind, how: F.transform(f"{how}_{kind}", lambda s: _proposal(kind, F.col("_text"), s, how == "rule"))
    each = [made(kind, how) for kind in KINDS for how in ("rule", "loose")]
    return found.select("doc_id", F.concat(*each).alias("spans"))


def _one_hot(values: Column, width: int) -> Column:
    """0/1 indicators of each of three values of ``width`` cells."""
    return F.transform(F.sequence(F.lit(0), F.lit(3 * width - 1)), lambda k: F.when(F.get(values, F.floor(k / 3).cast("int")) == k % 3, 1.0).otherwise(0.0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def fit(found: DataFrame, em_rounds: int = 15, descent_rounds: int = 150) -> DataFrame:
    """One row a kind: reliability (log odds of each labeler's votes; the prior last) and classifier weights (bias last)."""
    cells = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(F.count("*").cast("double").alias("n"))
    cells = cells.select("kind", "n", _one_hot(F.col("votes"), LABELERS).alias("v"), F.concat(_one_hot(F.col("votes"), LABELERS), _one_hot(F.col("shape"), 2)).alias("x"))
    kinds = cells.groupBy("kind").agg(F.collect_list(F.struct("n", "v", "x")).alias("cells"))
    width, wide = 3 * LABELERS, 3 * LABELERS + 6
    start = F.array(*[F.lit(float(k % 3 - 1)) for k in range(width)], F.lit(0.0))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    posterior = lambda c, w: _sigmoid(_dot(c["v"], F.slice(w, 1, width)) + F.element_at(w, -1))

    def em(w: Column, _: Column) -> Column:
        p = F.transform("cells", lambda c: F.struct((c["n"] * posterior(c, w)).alias("y"), (c["n"] * (1 - posterior(c, w))).alias("z"), c["v"].alias("v")))
        yes, no = total(F.transform(p, lambda c: c["y"])), total(F.transform(p, lambda c: c["z"]))
        share = lambda side, k, all_: (total(F.transform(p, lambda c: c[side] * F.get(c["v"], k))) + 0.5) / (all_ + 1.5)
        odds = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.log(share("y", k, yes)) - F.log(share("z", k, no)))
        return F.concat(odds, F.array(F.log((yes + 1.0) / (no + 1.0))))

    rated = kinds.withColumn("reliability", F.aggregate(F.sequence(F.lit(1), F.lit(em_rounds)), start, em))
    taught = rated.withColumn("taught", F.transform("cells", lambda c: F.struct((c["n"] / total(F.transform("cells", lambda d: d["n"]))).alias("n"), posterior(c, F.col("reliability")).alias("p"), F.concat(c["x"], F.array(F.lit(1.0))).alias("x"))))

    def descend(w: Column, _: Column) -> Column:
        slope = F.transform("taught", lambda c: F.transform(c["x"], lambda x: x * c["n"] * (c["p"] - _sigmoid(_dot(c["x"], w)))))
        summed = F.aggregate(slope, F.array_repeat(F.lit(0.0), wide + 1), lambda a, g: F.zip_with(a, g, lambda x, y: x + y))
        return F.zip_with(w, summed, lambda x, g: x + 2.0 * g - 0.0005 * x)

    return taught.select("kind", "reliability", F.aggregate(F.sequence(F.lit(1), F.lit(descent_rounds)), F.array_repeat(F.lit(0.0), wide + 1), descend).alias("weights"))


def classify(found: DataFrame, model: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans): spans of rules and the proposals that the classifier adds, with ``p``."""
    weights = {r.kind: r.weights for r in model.select("kind", "weights").collect()}  # a row a kind

    def p(s: Column) -> Column:
        x = F.concat(_one_hot(s["votes"], LABELERS), _one_hot(s["shape"], 2), F.array(F.lit(1.0)))
        cases = [(s["kind"] == k, _sigmoid(_dot(x, F.array(*map(F.lit, w))))) for k, w in weights.items()]
        return reduce(lambda c, kv: c.when(*kv), cases[1:], F.when(*cases[0])) if cases else F.lit(0.0)

    rated = found.withColumn("spans", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), p(s).alias("p"))))
    base = F.filter("spans", lambda s: s["base"])
    rated = rated.withColumn("rules", base)
    clear = lambda s: ~F.exists("rules", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return rated.select("doc_id", F.filter("spans", lambda s: s["base"] | ((s["p"] >= threshold) & clear(s))).alias("spans"))


def _joined(spans: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = stored(proposals(docs, id_col, text_col), "proposals")
    return classify(found, fit(found))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    from .tables import table

    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
