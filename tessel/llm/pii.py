"""Personal data: rule spans, and boosted trees over the candidates of high-recall generators.

Everything is DataFrame functions; no row goes through Python. Rule (base) spans of four kinds
always stay. Generators propose further, overlapping spans: spaced or masked addresses, dotted
quads with spaces, card-like and phone-like digit groups, and what the rules' patterns
match but their checks drop. Boosted trees of depth two score a candidate by format (digits,
separators, edges) and context (words before it). They learn from rule spans and masked forms
made of them against other proposed and number-like spans of all documents, without the very
features that the rules decide by, so a span that looks and stands like rule spans or their masked
forms scores high. What is plainly such a form is never taken as a counter-example; where there are
too few of these, in number or as a share that tells nothing at the precision asked for, only plain
forms are proposed. A kind's threshold is the lowest score at which at
least `precision` of all spans with it or a higher one are rule spans; with none, or with too few
rule spans, the kind adds nothing. Added spans never overlap a rule span or an earlier added one of
their kind.

Every document is read twice: once to count the spans of each feature cell, and once to score. The
number of cells is bounded by the features' values, whatever the input, and the trees are fitted to
these counts on the driver. Scoring is a sum of CASE expressions.

Patterns have no repeated groups and start only where a run of their characters starts, so a
text of a million equal characters takes linear time and no deep stack. Positions are code points.

Nulls: a null text is empty and has no spans. Repeated rows are reported as often. Other
columns are not read, so their names don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Characters for our own marks; such characters of a text are replaced by another of the same length.
EDGE, JOIN, STAND_IN = "\ue000", "\ue001", "\ue002"
RULES = {
    "email": rf"(?:\G|(?<![A-Za-z0-9._%+{JOIN}-]))[A-Za-z0-9._%+{JOIN}-]++@[A-Za-z0-9-]++{JOIN}[A-Za-z0-9{JOIN}-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": f"[0-9{JOIN}]{{13,}}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The end of a generator's match, which alone decides whether a text needs it.
MASKED_HOST = r"(?: ?@ ?| ?\(at\) ?| ?\[at\] ?| at )[a-z0-9-]{1,63}(?: ?\. ?| ?\(dot\) ?| ?\[dot\] ?| dot )[a-z]{2,10}(?![a-z0-9])"
GENERATORS = {
    "email": rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{2,64}}{MASKED_HOST}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?\. ?| ?\[\.\] ?)[0-9]{1,3}(?: ?\. ?| ?\[\.\] ?)[0-9]{1,3}(?: ?\. ?| ?\[\.\] ?)[0-9]{1,3}(?![0-9.])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
}
#: What a generator needs in a text to find anything.
NEEDS = {"email": rf"(?i){MASKED_HOST}", "ip": r"[0-9] ?(?:\.|\[\.\]) ?[0-9]", "card": r"[0-9]{4}", "phone": r"[0-9]{3}[ .-][0-9]{3}"}
#: What every masked host begins with.
AT = r"@|\([aA][tT]\)|\[[aA][tT]\]| [aA][tT] "
#: What is plainly a masked form. Of prose, "look at it. Then" and "us at example.com" are proposed too, and are none.
PLAIN = {
    "email": r"(?i)@|\(at\)|\[at\]|\(dot\)|\[dot\]| dot | \. |^[a-z0-9][a-z0-9._%+-]*(?:[._%+-][a-z0-9]+|[0-9]) at [a-z0-9-]+\.[a-z]{2,10}$",
    "ip": r"^[0-9]+(?:\.|\[\.\]| \. | \[\.\] )[0-9]+(?:\.|\[\.\]| \. | \[\.\] )[0-9]+(?:\.|\[\.\]| \. | \[\.\] )[0-9]+$",
    "card": r"^[0-9]",
    "phone": r"^(?:\([0-9]{2,4}\)[ .-]{1,2}|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}$",
}
#: Masked forms of a rule span: (pattern, replacement) each.
_HOST = r"@(?:.*\.)?([A-Za-z0-9-]+)\.([A-Za-z]{2,10})$"
FORMS = {
    "email": [(_HOST, at + "$1" + dot + "$2") for at, dot in ((" at ", "."), (" at ", " dot "), ("(at)", "."), ("(at)", "(dot)"), ("[at]", "[dot]"), ("@", "(dot)"), (" @ ", "."))],
    "ip": [(r"\.", "[.]"), (r"\.", " . ")],
    "card": [(r"^([0-9]{4})[ -]?([0-9]{4})[ -]?([0-9]{4})[ -]?([0-9]{1,7})$", "$1.$2.$3.$4")],
    "phone": [(r"^\+[0-9]{1,3}[ .-]?", ""), *((r"^\+[0-9]{1,3}[ .-]?\(?([0-9]{3})\)?[ .-]{1,2}([0-9]{3})[ .-]([0-9]{4})$", f"$1{x}$2{x}$3") for x in " .-")],
}
NUMBERS = r"(?<![0-9A-Za-z])[0-9][0-9 ().-]{2,22}[0-9](?![0-9A-Za-z])"
#: Fixed lists of words that stand before each kind.
CONTEXT = {"email": "mail|contact|write|reach|address", "ip": r"\bip\b|host|server|addr|from|client", "card": "card|visa|master|credit|debit|pay|account", "phone": "tel|phone|call|mobile|cell|fax|dial|contact"}
FEATURES = ("digits", "separators", "own_context", "other_context", "left_edge", "right_edge", "length")
SPAN = "array<struct<kind:string,start:bigint,end:bigint,found:string>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


def _spans(kind: str, text: Column, marked: Column, pattern: str) -> Column:
    """All matches of a pattern in `marked`, a text of the same code points, with what stands there in `text`."""
    pieces = F.split(F.regexp_replace(marked, pattern, EDGE + "$0" + EDGE), EDGE)

    def step(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        span = F.struct(F.lit(kind).alias("kind"), state["at"].alias("start"), end.alias("end"), F.substring(text, (state["at"] + 1).cast("int"), F.length(piece)).alias("found"))
        return F.struct(end.alias("at"), (~state["inside"]).alias("inside"), F.when(state["inside"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("inside"), _none().alias("spans"))
    return F.aggregate(pieces, start, step)["spans"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        def small(part: Column) -> Column:
            own = F.regexp_replace(part, "^0+", "")
            return (F.length(own) <= 2) | (F.length(own) == 3) & (own <= "255")

        return F.forall(F.split(found, r"\."), small)
    if kind == "card":
        digits = _digits(found)
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _marked(kind: str, text: Column) -> Column:
    """Joins inside a match become one mark, so a match is one run of a character class."""
    if kind == "email":
        return F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOIN)
    if kind == "card":
        return F.regexp_replace(text, r"(?<=[0-9])[ -](?=[0-9])", JOIN)
    return text


def _checked(kind: str) -> Column:
    return F.filter(f"raw_{kind}", lambda s: _valid(kind, s["found"]))


def _cell(kind: str, label: int, spans: Column) -> Column:
    """The features of each span, with its kind and label."""
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), *(c.cast("int").alias(n) for n, c in zip(FEATURES, _features(kind, s), strict=True))))


def with_rule_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds `raw_<kind>` (all matches of the rule's pattern) and `base_<kind>` (those that pass its check)."""
    plain = F.translate(F.col(text), EDGE + JOIN, STAND_IN * 2)
    out = docs.withColumn("plain", plain).withColumn("numeric", F.col("plain").rlike("[0-9]"))
    for kind in KINDS:
        gate = F.col("plain").contains("@") if kind == "email" else F.col("numeric") & F.col("plain").rlike({"ip": r"[0-9]\.[0-9]++\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}[kind])
        out = out.withColumn(f"raw_{kind}", F.when(gate, _spans(kind, F.col("plain"), _marked(kind, F.col("plain")), RULES[kind])).otherwise(_none()))
    for kind in KINDS:
        out = out.withColumn(f"base_{kind}", _checked(kind))
    return out


def _apart(spans: Column, others: Column) -> Column:
    """Those of spans that overlap none of others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))


def _needs(kind: str) -> Column:
    """Whether a text holds what a generator needs; a dear pattern only runs where a cheap one has matched."""
    plain = F.col("plain")
    return (plain.rlike(AT) & plain.rlike(NEEDS[kind])) if kind == "email" else plain.rlike(NEEDS[kind])


def _candidates(kind: str) -> Column:
    plain = F.col("plain")
    made = F.when(_needs(kind), _spans(kind, plain, plain, GENERATORS[kind])).otherwise(_none())
    if kind == "ip":  # what cannot be an address is none, whatever it looks like
        return F.filter(made, lambda s: _valid("ip", F.regexp_replace(s["found"], "[^0-9.]", "")))
    return F.array_distinct(F.concat(made, F.array_except(F.col(f"raw_{kind}"), F.col(f"base_{kind}"))))


def _plain(kind: str, found: Column) -> Column:
    """Whether what a generator proposed is plainly a masked form of its kind."""
    return found.rlike(PLAIN[kind]) & (_valid("card", found) if kind == "card" else F.lit(True))


def _plain_ones(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _plain(kind, s["found"]))


def _masked_forms(kind: str, spans: Column) -> Column:
    """Rule spans as they would read when masked, in the same place."""
    made = F.flatten(F.transform(spans, lambda s: F.array(*(s.withField("found", F.regexp_replace(s["found"], a, b)) for a, b in FORMS[kind]))))
    return F.filter(F.array_except(made, spans), lambda s: _plain(kind, s["found"]))


def _features(kind: str, s: Column) -> list[Column]:
    plain = F.col("plain")
    before = F.lower(F.substring(plain, F.greatest(s["start"] - 23, F.lit(1)).cast("int"), F.least(s["start"], F.lit(24)).cast("int")))
    left = F.when(s["start"] == 0, " ").otherwise(F.substring(plain, s["start"].cast("int"), F.lit(1)))
    right = F.substring(plain, (s["end"] + 1).cast("int"), F.lit(1))
    found = s["found"]
    if kind == "email":  # how the parts are set apart: an at sign or mark, a dot mark, a point in a plain form, prose
        apart = F.when(found.rlike(r"(?i)@|\(at\)|\[at\]"), 3).when(found.rlike(r"(?i)\(dot\)|\[dot\]| dot | \. "), 2).when(_plain(kind, found), 1).otherwise(0)
    else:
        apart = F.least(F.length(F.regexp_replace(found, r"[^ ().\[\]@-]", "")), F.lit(6))
    others = "|".join(v for k, v in CONTEXT.items() if k != kind)
    return [
        F.lit(0) if kind == "email" else F.least(F.length(_digits(found)), F.lit(20)),  # an address may have none
        apart,
        before.rlike(CONTEXT[kind]).cast("int"),
        before.rlike(others).cast("int"),
        left.rlike(r"[\s(\[,;:]").cast("int"),
        ((right == "") | right.rlike(r"[\s)\],;:.!?]")).cast("int"),
        F.least(F.floor(F.length(s["found"]) / 4), F.lit(8)).cast("int"),
    ]


def boosted(cells: list[tuple[tuple[int, ...], float, float]], rounds: int = 20, rate: float = 0.3) -> tuple[float, list[tuple]]:
    """Gradient boosting of log-odds over (features, positives, negatives): the start and trees (f, cut, left, right), where a side is a value or (f, cut, low, high)."""
    pos, neg = sum(c[1] for c in cells), sum(c[2] for c in cells)
    start = math.log((pos + 1) / (neg + 1))
    score, trees = [start] * len(cells), []

    def split(rows: list[int], grad: list[float], hess: list[float]):
        def gain(g: float, h: float) -> float:
            return g * g / (h + 1.0)

        best, g_all, h_all = None, sum(grad[i] for i in rows), sum(hess[i] for i in rows)
        for f in range(len(FEATURES)):
            by: dict[int, list[float]] = {}
            for i in rows:
                at = by.setdefault(cells[i][0][f], [0.0, 0.0])
                at[0] += grad[i]
                at[1] += hess[i]
            g = h = 0.0
            for cut in sorted(by)[:-1]:
                g, h = g + by[cut][0], h + by[cut][1]
                won = gain(g, h) + gain(g_all - g, h_all - h) - gain(g_all, h_all)
                if won > 1e-9 and (best is None or won > best[0]):
                    best = (won, f, cut)
        return best and best[1:], rate * g_all / (h_all + 1.0)

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [c[1] - (c[1] + c[2]) * q for c, q in zip(cells, p, strict=True)]
        hess = [(c[1] + c[2]) * q * (1 - q) for c, q in zip(cells, p, strict=True)]
        rule, value = split(list(range(len(cells))), grad, hess)
        if rule is None:
            break
        sides = []
        for high in (False, True):
            rows = [i for i, c in enumerate(cells) if (c[0][rule[0]] > rule[1]) is high]
            own, value = split(rows, grad, hess)
            if own is None:
                sides.append(value)
            else:
                sides.append((*own, split([i for i in rows if cells[i][0][own[0]] <= own[1]], grad, hess)[1], split([i for i in rows if cells[i][0][own[0]] > own[1]], grad, hess)[1]))
        trees.append((*rule, *sides))
        score = [s + tree_value(trees[-1], c[0]) for s, c in zip(score, cells, strict=True)]
    return start, trees


def tree_value(tree, features: tuple[int, ...]) -> float:
    while isinstance(tree, tuple):
        tree = tree[3] if features[tree[0]] > tree[1] else tree[2]
    return tree


def threshold(cells: list, model: tuple[float, list], precision: float) -> float | None:
    """The lowest score at which at least this share of the spans with it or a higher one are positive."""
    scored = sorted(((model[0] + sum(tree_value(t, c[0]) for t in model[1]), c[1], c[2]) for c in cells), reverse=True)
    pos = neg = 0.0
    best = None
    for i, (score, p, n) in enumerate(scored):
        pos, neg = pos + p, neg + n
        if (i + 1 == len(scored) or scored[i + 1][0] < score) and pos >= precision * (pos + neg):
            best = score
    return best


def fit(docs: DataFrame, *, precision: float = 0.95, least: int = 30) -> dict[str, tuple]:
    """Model and threshold of each kind, from a table with rule spans."""
    cells: dict[str, dict[tuple, list[float]]] = {k: {} for k in KINDS}
    plain = F.col("plain")
    numbers = F.when(plain.rlike("[0-9]{3}"), _spans("number", plain, plain, NUMBERS)).otherwise(_none())
    # columns of their own, so each is found once for a document, however often it is used below
    docs = docs.where(F.col("numeric") | plain.contains("@") | _needs("email")).withColumns({"numbers": numbers, "every": F.concat(*(F.col(f"base_{k}") for k in KINDS)), **{f"own_{k}": _candidates(k) for k in KINDS}})
    docs = docs.withColumns({f"masked_{k}": _plain_ones(k, F.col(f"own_{k}")) for k in KINDS})
    parts = []
    for kind in KINDS:
        own, masked = F.col(f"own_{kind}"), F.col(f"masked_{kind}")
        wrong = _apart(F.array_except(own, masked) if kind == "email" else F.concat(F.array_except(own, masked), F.col("numbers")), F.concat(F.col("every"), masked))
        base = F.col(f"base_{kind}")
        parts += [_cell(kind, 1, base), _cell(kind, 2, _masked_forms(kind, base)), _cell(kind, 0, wrong)]
    rows = docs.select(F.explode(F.concat(*parts)).alias("c")).groupBy("c.kind", "c.label", *(f"c.{n}" for n in FEATURES)).count()
    for r in rows.collect():  # at most the number of feature combinations
        # a rule span weighs as much with its masked forms as a counter-example does
        weight = {0: 1.0, 1: 0.5, 2: 0.5 / len(FORMS[r["kind"]])}[r["label"]]
        cells[r["kind"]].setdefault(tuple(r[n] for n in FEATURES), [0.0, 0.0])[r["label"] == 0] += r["count"] * weight
    out = {}
    for kind, own in cells.items():
        table = [(f, *n) for f, n in sorted(own.items())]
        pos, neg = sum(c[1] for c in table), sum(c[2] for c in table)
        if pos >= least / 2:
            model = boosted(table)
            if (cut := threshold(table, model, precision)) is not None:
                # if all spans together reach the precision, however many they are, the threshold lets everything pass
                out[kind] = (model, cut, neg < least or pos >= precision * (pos + neg))
    return out


def _tree_column(tree, features: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(features[tree[0]] > tree[1], _tree_column(tree[3], features)).otherwise(_tree_column(tree[2], features))


def _added(kind: str, model: tuple, cut: float, plain_only: bool, every: Column) -> Column:
    proposed = _plain_ones(kind, _candidates(kind)) if plain_only else _candidates(kind)
    described = F.transform(_apart(proposed, every), lambda s: F.struct(s.alias("span"), F.array(*(f.cast("int") for f in _features(kind, s))).alias("f")))

    def good(x: Column) -> Column:
        score = F.lit(float(model[0]))
        for tree in model[1]:
            score = score + _tree_column(tree, [x["f"][i] for i in range(len(FEATURES))])
        return score >= cut - 1e-9

    kept = F.array_sort(F.transform(F.filter(described, good), lambda x: x["span"]), lambda a, b: F.when(a["start"] != b["start"], (a["start"] - b["start"]).cast("int")).otherwise((b["end"] - a["end"]).cast("int")))
    return F.aggregate(kept, _none(), lambda held, s: F.when((F.size(held) > 0) & (F.coalesce(F.try_element_at(held, F.lit(-1))["end"], F.lit(0)) > s["start"]), held).otherwise(F.array_append(held, s)))


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, precision: float = 0.95) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, found.

    `found` holds the spans of both sorts as structs (kind, start, end, found).
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    rows = with_rule_spans(source, "body")
    models = fit(rows, precision=precision)
    every = F.concat(*(F.col(f"base_{k}") for k in KINDS))
    for kind in KINDS:
        added = F.when(_needs(kind) if kind == "email" else F.col("numeric"), _added(kind, *models[kind], every)).otherwise(_none()) if kind in models else _none()
        rows = rows.withColumn(f"added_{kind}", added)

    def by_start(spans: Column) -> Column:
        return F.array_sort(spans, lambda a, b: (a["start"] - b["start"]).cast("int"))

    found = F.concat(*(by_start(F.concat(f"base_{k}", f"added_{k}")) for k in KINDS))
    return rows.select(
        "doc_id",
        *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_named(every), 256).alias("base_sha256"),
        _named(found).alias("spans"),
        sum((F.size(f"added_{k}") for k in KINDS), F.lit(0)).cast("long").alias("n_added"),
        found.alias("found"),
    )
