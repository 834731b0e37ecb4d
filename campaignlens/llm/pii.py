"""Personal data: high-recall span generators and boosted trees over format and context, in built-in functions only.

Regular expressions propose overlapping spans. Those of the base kinds that pass their check (digits, ranges, Luhn)
are found as they are. Spans of the added kinds (spelled-out mail addresses, numbers without a country code, identifiers) have no check: boosted trees
score them by their format and their surroundings. Labels come from what the trees do not see: of a base span the outcome of its check, of a number or
identifier whether a word such as "phone" or "passport" stands before it, of a spelled-out address whether it ends in a
well-known domain. So a format which such words usually announce is found also where none does. For each added kind a threshold is calibrated
on documents of a held-out fold. Each feature has few levels, so a count for each combination of
levels is all that training needs: Spark aggregates it. Where combinations are few, training reads them all; where they are many, they stay in Spark, and
training reads sums of gradients for each leaf, feature and level.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from campaignlens.llm.common import materialize

# Kinds as spans of one start are listed. Quantifiers are possessive where nothing can follow that they would give back, so that long runs take
# linear time and no stack; a mail address starts where its run of characters does, or the match before it ended.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("mail", "number", "ident")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![0-9])(?![\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail": r"(?i)[A-Za-z0-9._%+-]{1,64}\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,5}",
    "number": r"(?<![0-9+])\(?[0-9][0-9\x20().-]{5,22}[0-9](?![0-9])",
    "ident": r"(?<![A-Za-z0-9])[A-Z]{1,3}-?[0-9]{5,9}(?![A-Za-z0-9])",
}
# A text without such characters has no spans of the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]", "mail": r"(?i)\bdot\b", "number": r"[0-9]", "ident": r"[A-Z]-?[0-9]"}
# Words that announce personal data, and well-known top-level domains. Labels come from them; no feature does.
ANNOUNCED = r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|whatsapp|ssn|social security|passport|licen[cs]e|account|iban)\b[^\n0-9]{0,14}$"
DOMAINS = r"(?i)(?:com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|us|ca|au|ch|at|eu)$"
FEATURES = ("rank", "digits", "letters", "dots", "paren", "groups", "first", "last", "before", "after", "colon")


SPAN = "array<struct<s:int,e:int,t:string,b:string,a:string>>"


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def matches(text: Column, pattern: str, needs: str) -> Column:
    """All matches in turn: start and end (code points), text, up to 30 characters between it and the match before, and the character after it.

    Places come from the lengths of the matches and of what lies between them. These are summed up in blocks of about the root of their
    number and then over the blocks, as a fold that appends copies what it has.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    parts = let(
        F.struct(found.alias("m"), between.alias("p")),
        lambda x: F.zip_with(
            F.zip_with(x["m"], F.slice(x["p"], 1, F.size(x["m"])), lambda m, p: F.struct(m.alias("t"), F.length(p).alias("p"), F.right(p, F.lit(30)).alias("b"))),
            F.slice(x["p"], 2, F.size(x["m"])),
            lambda y, after: F.struct(y["t"].alias("t"), y["p"].alias("p"), F.length(y["t"]).alias("n"), y["b"].alias("b"), F.left(after, F.lit(1)).alias("a")),
        ),
    )

    def summed(block: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["p"] + x["n"]).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["p"]).alias("s"), (acc["at"] + x["p"] + x["n"]).alias("e"), x["t"].alias("t"), x["b"].alias("b"), x["a"].alias("a")))).alias("out"),
            ),
        )

    def placed(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["parts"]) - 1) / x["wide"]).cast("int")), lambda i: summed(F.slice(x["parts"], i * x["wide"] + 1, x["wide"])))
        return F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
            lambda acc, block: F.struct(
                (acc["at"] + block["at"]).alias("at"),
                F.concat(acc["out"], F.array(F.transform(block["out"], lambda y: y.withField("s", y["s"] + acc["at"]).withField("e", y["e"] + acc["at"])))).alias("out"),
            ),
            lambda acc: F.flatten(acc["out"]),
        )

    none = F.array().cast(SPAN)
    sized = lambda parts: F.when(F.size(parts) > 0, let(F.struct(parts.alias("parts"), F.ceil(F.sqrt(F.size(parts))).cast("int").alias("wide")), placed)).otherwise(none)
    return F.when(text.rlike(needs), let(parts, sized)).otherwise(none)


def only_digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(t: Column) -> Column:
    """Whether the digits' weighted sum ends in 0."""
    digits = F.filter(F.split(F.reverse(only_digits(t)), ""), lambda c: c != "")
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    values = F.transform(digits, lambda c, i: F.when(i % 2 == 1, F.element_at(doubled, c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10 == 0


def passes(kind: str, t: Column) -> Column:
    n = F.length(only_digits(t))
    if kind == "ip":
        return F.forall(F.split(t, r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return n.between(14, 19) & luhn(t)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(kind == "email")


def side(c: Column) -> Column:
    """Of a neighbouring character: none 0, white space 1, letter or digit 2, other 3."""
    return F.when(F.length(c) == 0, 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def described(rank: int, t: Column, before: Column, after: Column) -> list[Column]:
    """The features of a span, each of a few levels."""
    count = lambda pattern, most: F.least(F.length(F.regexp_replace(t, pattern, "")), F.lit(most))
    run = lambda pattern: F.least(F.length(F.regexp_extract(t, pattern, 1)), F.lit(9))
    made = {
        "rank": F.lit(rank),
        "digits": count("[^0-9]", 20),
        "letters": F.least(F.lit(3), F.ceil(count(r"[^\p{L}]", 12) / 4)).cast("int"),
        "dots": count(r"[^.]", 4),
        "paren": F.contains(t, F.lit("(")).cast("int"),
        "groups": F.least(F.length(F.regexp_replace(F.regexp_replace(t, "[0-9]+", "0"), "[^0]", "")), F.lit(6)),
        "first": run("^[^0-9]*([0-9]*)"),
        "last": run("([0-9]*)[^0-9]*$"),
        "before": side(F.right(before, F.lit(1))),
        "after": side(after),
        "colon": before.rlike(r"[:#=]\s*$").cast("int"),
    }
    return [made[f].alias(f) for f in FEATURES]


def labelled(kind: str, t: Column, before: Column) -> Column:
    """The outcome of a base span's check, or what announces a span of an added kind."""
    if kind in BASE_KINDS:
        return passes(kind, t)
    return t.rlike(DOMAINS) if kind == "mail" else before.rlike(ANNOUNCED)


def _described_as(kind: str, rank: int):
    """A function of a span, for ``transform``."""
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("start"), x["e"].alias("end"), labelled(kind, x["t"], x["b"]).alias("ok"), *described(rank, x["t"], x["b"], x["a"]))


def propose(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Append ``found``: of each generator its spans, their labels and features; and ``fold``, a hash of the text modulo 4.

    Those of added kinds are looked for between what the base generators match, as one expression matches either.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    checked = "|".join(PATTERNS[kind] for kind in BASE_KINDS)
    spans = docs
    for kind, pattern in PATTERNS.items():
        if kind in BASE_KINDS:
            found = matches(text, pattern, NEEDS[kind])
        else:
            found = F.filter(matches(text, f"{checked}|{pattern}", NEEDS[kind]), lambda x: ~x["t"].rlike(f"^(?:{checked})$"))
        spans = spans.withColumn(f"__{kind}", found)
    parts = [F.transform(f"__{kind}", _described_as(kind, rank)) for rank, kind in enumerate(PATTERNS)]
    return spans.withColumn("found", F.concat(*parts)).withColumn("fold", F.pmod(F.xxhash64(text), F.lit(4))).drop(*[f"__{k}" for k in PATTERNS])


@dataclass(frozen=True)
class Tree:
    feature: int = -1
    cut: int = 0
    low: Tree | None = None
    high: Tree | None = None
    value: float = 0.0

    def column(self, span: Column | DataFrame) -> Column:
        if self.feature < 0:
            return F.lit(self.value)
        return F.when(span[FEATURES[self.feature]] <= self.cut, self.low.column(span)).otherwise(self.high.column(span))

    def values(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.low.values(x), self.high.values(x))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree:
    """The tree of greatest gain for gradients and curvatures of weighted combinations."""
    best, at = 1e-6, None
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    whole = gain(np.ones(len(x), bool))
    for f in range(x.shape[1]) if depth else ():
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            if (found := gain(low) + gain(~low) - whole) > best:
                best, at = found, (f, int(cut), low)
    if at is None:
        return Tree(value=float(-g.sum() / (h.sum() + 1.0)))
    f, cut, low = at
    return Tree(f, cut, grow(x[low], g[low], h[low], depth - 1), grow(x[~low], g[~low], h[~low], depth - 1))


@dataclass(frozen=True)
class Boosted:
    trees: tuple[Tree, ...]
    base: float
    thresholds: dict[str, float]  # of an added kind; those without one select nothing

    def score(self, span: Column) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + tree.column(span)
        return 1 / (1 + F.exp(-total))

    def selects(self, span: Column) -> Column:
        chosen = [(span["kind"] == kind) & (self.score(span) >= least) for kind, least in self.thresholds.items()]
        return reduce(Column.__or__, chosen, F.lit(False))


def fit_boosted(x: np.ndarray, ones: np.ndarray, all_: np.ndarray, held_ones: np.ndarray, held_all: np.ndarray, rounds: int = 25, depth: int = 3, rate: float = 0.3, precision: float = 0.5, fewest: int = 3) -> Boosted:
    """Newton boosting over combinations with counts. An added kind's threshold is the lowest score from which on the share of held-out label 1 suffices.

    That share is of labels, which miss what nothing announces, so it is a lower bound of the precision.
    """
    share = min(max(ones.sum() / max(1, all_.sum()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    z, trees = np.full(len(x), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        scaled = _scaled(grow(x, all_ * p - ones, all_ * p * (1 - p), depth), rate)
        trees.append(scaled)
        z = z + scaled.values(x)
    p, thresholds = 1 / (1 + np.exp(-z)), {}
    for rank, kind in enumerate(PATTERNS):
        own = np.flatnonzero(x[:, 0] == rank)
        order = own[np.argsort(-p[own], kind="stable")]
        upto = np.cumsum(held_all[order])
        # combinations of one score stand or fall together
        good = (np.cumsum(held_ones[order]) >= precision * upto) & (upto >= fewest) & np.append(np.diff(p[order]) < 0, True)[: len(order)]
        if kind in ADDED_KINDS and good.any():
            thresholds[kind] = float(p[order][np.flatnonzero(good)[-1]]) - 1e-9
    return Boosted(tuple(trees), base, thresholds)


def _scaled(tree: Tree, rate: float) -> Tree:
    if tree.feature < 0:
        return Tree(value=tree.value * rate)
    return Tree(tree.feature, tree.cut, _scaled(tree.low, rate), _scaled(tree.high, rate))


def grow_spread(rows: DataFrame, depth: int) -> Tree:
    """``grow`` where combinations are rows with ``g`` and ``h``: each level of the tree is one sum for each leaf, feature and level of the feature."""
    splits: dict[int, tuple[int, int]] = {}
    values: dict[int, float] = {}

    def leaf(n: int) -> Column:
        if n not in splits:
            return F.lit(n)
        f, cut = splits[n]
        return F.when(F.col(FEATURES[f]) <= cut, leaf(2 * n)).otherwise(leaf(2 * n + 1))

    def tree(n: int) -> Tree:
        if n not in splits:
            return Tree(value=values[n])
        f, cut = splits[n]
        return Tree(f, cut, tree(2 * n), tree(2 * n + 1))

    for level in range(depth + 1):
        parts = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(c).cast("int").alias("v")) for f, c in enumerate(FEATURES)])).alias("x")
        sums: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
        for r in rows.select(leaf(1).alias("leaf"), "g", "h", parts).groupBy("leaf", "x.f", "x.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            sums.setdefault(r.leaf, {}).setdefault(r.f, {})[r.v] = r.g, r.h
        for n in [n for n in sums if n >= 2**level]:  # leaves of this level; those above it have their values
            by = {f: np.array([(v, *gh) for v, gh in sorted(levels.items())]) for f, levels in sorted(sums[n].items())}
            g, h = by[0][:, 1].sum(), by[0][:, 2].sum()
            values[n], best = float(-g / (h + 1.0)), 1e-6
            for f, x in by.items() if level < depth else ():
                for i in range(1, len(x)):
                    low_g, low_h = x[:i, 1].sum(), x[:i, 2].sum()
                    if (found := low_g**2 / (low_h + 1.0) + (g - low_g) ** 2 / (h - low_h + 1.0) - g**2 / (h + 1.0)) > best + 1e-9:
                        best, splits[n] = found, (f, int(x[i - 1, 0]))
    return tree(1)


def fit_spread(table: DataFrame, rounds: int = 25, depth: int = 3, rate: float = 0.3, precision: float = 0.5, fewest: int = 3, bins: int = 256) -> Boosted | None:
    """``fit_boosted`` on all combinations of ``table`` (features, ones, all, held_ones, held), which stay in Spark; of any number."""
    total = table.agg(F.sum("ones").alias("ones"), F.sum("all").alias("all")).first()
    if not total.ones or total.ones == total.all:
        return None
    share = min(max(total.ones / max(1, total.all), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    model = Boosted((), base, {})
    for _ in range(rounds):
        p = model.score(table)
        rows = table.withColumn("p", p).withColumn("g", F.col("all") * F.col("p") - F.col("ones")).withColumn("h", F.col("all") * F.col("p") * (1 - F.col("p")))
        model = Boosted((*model.trees, _scaled(grow_spread(rows, depth), rate)), base, {})
    # Held-out labels by score, from the highest on: sums over bins of scores first, then within each bin, so that no task has all scores.
    scored = table.where(F.col("rank").isin(*[list(PATTERNS).index(k) for k in ADDED_KINDS])).select("rank", model.score(table).alias("p"), "held_ones", "held")
    scored = scored.groupBy("rank", "p").agg(F.sum("held_ones").alias("ones"), F.sum("held").alias("all")).withColumn("bin", F.floor(F.col("p") * bins))
    wide = Window.partitionBy("rank").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    before = scored.groupBy("rank", "bin").agg(F.sum("ones").alias("o"), F.sum("all").alias("a"))
    before = before.select("rank", "bin", F.coalesce(F.sum("o").over(wide), F.lit(0)).alias("o"), F.coalesce(F.sum("a").over(wide), F.lit(0)).alias("a"))
    within = Window.partitionBy("rank", "bin").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    upto = scored.join(before, ["rank", "bin"]).select("rank", "p", (F.col("o") + F.sum("ones").over(within)).alias("ones"), (F.col("a") + F.sum("all").over(within)).alias("all"))
    good = upto.where((F.col("ones") >= precision * F.col("all")) & (F.col("all") >= fewest)).groupBy("rank").agg(F.min("p").alias("p"))
    return Boosted(model.trees, base, {list(PATTERNS)[r["rank"]]: r["p"] - 1e-9 for r in good.orderBy("rank").collect()})


def train(proposed: DataFrame, combinations: int = 20_000) -> Boosted | None:
    """Count combinations of levels over all spans by label and fold, and fit on all of them: up to ``combinations`` are read, more stay in Spark. Without both labels there is no model."""
    rows = proposed.select(F.explode("found").alias("s"), "fold").select("s.*", "fold")
    held = F.col("fold") == 0
    count = lambda c: F.sum(c.cast("int")).alias
    table = rows.groupBy(*FEATURES).agg(count(F.col("ok") & ~held)("ones"), count(~held)("all"), count(F.col("ok") & held)("held_ones"), count(held)("held"))
    got = table.orderBy(F.desc(F.col("all") + F.col("held")), *FEATURES).limit(combinations + 1).collect()
    if len(got) > combinations:
        return fit_spread(materialize(table, "combinations"))
    x = np.array([[r[f] for f in FEATURES] for r in got], int).reshape(-1, len(FEATURES))
    ones, all_, h1, h = (np.array([r[c] for r in got], float) for c in ("ones", "all", "held_ones", "held"))
    if not ones.sum() or ones.sum() == all_.sum():
        return None
    return fit_boosted(x, ones, all_, h1, h)


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Append ``spans``: kind, start, end (code points, end exclusive) of personal data in each whole text, by start and then kind.

    Spans of the base kinds are all matches that pass their check. Spans of the added kinds are those that the
    trained trees select between the proposed base spans, whether these pass or not. Null and empty texts have no spans. Repeated rows are looked at each. The
    text column is left out; a column named ``spans`` is replaced, one named ``found``, ``fold``, ``base`` or ``added`` left out.
    """
    kept = [c for c in docs.columns if c.lower() not in ("spans", "found", "fold", "base", "added", text_col.lower())]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))
    proposed = materialize(propose(given, "__text").drop("__text"), "proposed")
    model = train(proposed)
    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS) & x["ok"])
    added = F.filter("found", lambda x: x["kind"].isin(*ADDED_KINDS) & (model.selects(x) if model else F.lit(False)))
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end"))))
    spans = F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return proposed.withColumn("base", base).withColumn("added", added).select(*[F.col(f"`{c}`") for c in kept], spans.alias("spans"))
