"""Quality rules as a learned decision list.

Sequential covering on labelled statistics: a rule is a conjunction of
thresholds, grown on two thirds of the labelled rows by information gain,
pruned on the last third, and kept only if it stays precise there. The list
is emitted as one ordered Spark conditional expression, so scoring a corpus
is a single narrow stage without a shuffle and without Python.

Only the bounded sample of labelled statistics (``max_labels`` rows of about
ten numbers) ever reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, pinned, words

#: Fixed base rule of the contract.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Ratios that rules may test, as SQL over the statistics columns.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs"]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics columns of :data:`STATS` as one struct ``__llm_q``.

    A null or empty text has zero of everything. Words are maximal runs of
    characters other than the six ASCII white-space characters; a repeated
    window is a triple of words found twice or more, compared by a 64-bit hash
    inside one document. The windows are sorted only where hashing shows that
    any repeats, and cost is n log n in the document's words.
    """
    t, w, h, s, p = (f"{OWN}{x}" for x in ("t", "w", "h", "s", "p"))
    removed = lambda chars: f"length({t}) - length(translate({t}, '{chars}', ''))"
    out = (
        docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
        .withColumn(w, F.expr(words(t)))
        .withColumn(h, F.expr(f"transform(slice({w}, 1, greatest(size({w}) - 2, 0)), (x, i) -> xxhash64(x, get({w}, i + 1), get({w}, i + 2)))"))
        .withColumn(s, F.expr(f"if(size(array_distinct({h})) < size({h}), sort_array(transform({h}, (x, i) -> named_struct('h', x, 'i', i))), array())"))
        .withColumn(p, F.expr(f"sort_array(transform(filter({s}, (x, j) -> x.h = get({s}, j - 1).h or x.h = get({s}, j + 1).h), x -> x.i))"))
        .withColumn(f"{OWN}l", F.expr(f"filter(split({t}, '\\n'), x -> length(translate(x, ' \\t\\n\\u000b\\u000c\\r', '')) > 0)"))
        .withColumn(
            f"{OWN}q",
            F.struct(
                F.expr(f"cast(size({w}) as bigint)").alias("n_words"),
                F.expr(f"cast(length(translate({t}, ' \\t\\n\\u000b\\u000c\\r', '')) as bigint)").alias("word_chars"),
                F.expr(f"cast({removed(SYMBOLS)} as bigint)").alias("n_symbols"),
                F.expr(f"cast(size({OWN}l) - size(array_distinct({OWN}l)) as bigint)").alias("n_dup_lines"),
                F.expr(f"aggregate(transform({p}, (x, j) -> least(3, coalesce(get({p}, j + 1) - x, 3))), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
                F.expr(f"cast(size({OWN}l) as bigint)").alias("n_lines"),
                F.expr(f"cast({removed(UPPER)} as bigint)").alias("n_upper"),
                F.expr(f"cast({removed('!')} as bigint)").alias("n_bangs"),
            ),
        )
        .drop(t, w, h, s, p, f"{OWN}l")
    )
    return pinned(out, f"{OWN}q")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.threshold if self.above else row[self.feature] <= self.threshold

    def sql(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float = 0.0
    covered: int = 0

    def holds(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)

    def sql(self) -> str:
        return " and ".join(c.sql() for c in self.conditions)


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects the document, else it is kept."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """The number of the first rule that holds, from 1; null if none does.

        Reads the statistics from columns of their own names.
        """
        out = None
        for i, rule in enumerate(self.rules, 1):
            out = (F if out is None else out).when(F.expr(rule.sql()), F.lit(i))
        return F.lit(None).cast("int") if out is None else out

    def __str__(self) -> str:
        return "\n".join(f"{i}. reject if {r.sql()}  [{r.precision:.3f} of {r.covered}]" for i, r in enumerate(self.rules, 1)) + "\nelse keep"


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2((p1 + 1e-9) / (p1 + n1 + 1e-9)) - math.log2((p0 + 1e-9) / (p0 + n0 + 1e-9)))


def _grow(rows: list[dict], cuts: dict[str, list[float]], most: int) -> list[Condition]:
    conditions: list[Condition] = []
    while len(conditions) < most:
        p0 = sum(r["bad"] for r in rows)
        n0 = len(rows) - p0
        if not p0 or not n0:
            break
        best, gain = None, 1e-6
        for name, values in cuts.items():
            # one sorted pass per feature gives the counts at every cut
            ordered = sorted((r[name], r["bad"]) for r in rows)
            k = bad = 0
            for cut in values:
                while k < len(ordered) and ordered[k][0] < cut:
                    bad += ordered[k][1]
                    k += 1
                for above, p, n in ((True, p0 - bad, n0 - (k - bad)), (False, bad, k - bad)):
                    if p and (g := _gain(p0, n0, p, n)) > gain:
                        best, gain = Condition(name, above, cut if above else math.nextafter(cut, -math.inf)), g
        if best is None:
            break
        conditions.append(best)
        rows = [r for r in rows if best.holds(r)]
    return conditions


def learn(rows: list[dict], *, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.95, min_covered: int = 5, cuts: int = 48) -> DecisionList:
    """Sequential covering over rows of feature values with ``bad`` (0 or 1) and ``part`` (0, 1 or 2).

    Rows of parts 0 and 1 grow a rule, rows of part 2 prune it. A pruned rule
    enters the list only if the share of bad ones among all remaining rows that
    it covers reaches ``min_precision``, and they are ``min_covered`` at least; the
    first that does not ends the list. The Laplace precision is kept beside it, for
    reading. Of equal gains the first feature and the lowest cut win, and rows are
    taken as they come: repeated ones count as often. No rows or one class give an
    empty list, which keeps everything.
    """
    out = DecisionList()
    thresholds = {}
    for name in FEATURES:
        values = sorted({r[name] for r in rows})
        mids = [(a + b) / 2 for a, b in zip(values, values[1:])]
        thresholds[name] = sorted({mids[i * (len(mids) - 1) // max(1, cuts - 1)] for i in range(cuts)}) if mids else []
    rest = list(rows)
    while len(out.rules) < max_rules:
        grown = _grow([r for r in rest if r["part"] != 2], thresholds, max_conditions)
        if not grown:
            break
        prune = [r for r in rest if r["part"] == 2]

        def worth(conditions: list[Condition]) -> float:
            hit = [r["bad"] for r in prune if all(c.holds(r) for c in conditions)]
            return (2 * sum(hit) - len(hit)) / len(hit) if hit else -1.0

        best = max((grown[:k] for k in range(len(grown), 0, -1)), key=worth)
        hit = [r["bad"] for r in rest if all(c.holds(r) for c in best)]
        precision = (sum(hit) + 1) / (len(hit) + 2)
        if sum(hit) < min_covered or sum(hit) < min_precision * len(hit):
            break
        out.rules.append(Rule(tuple(best), precision, len(hit)))
        rest = [r for r in rest if not out.rules[-1].holds(r)]
    return out


def fit(docs: DataFrame, labels: DataFrame, *, max_labels: int = 6000, **options) -> DecisionList:
    """Learn the list from at most ``max_labels`` labelled documents, picked by a hash of the id.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad); rows with a null
    in either are skipped, and so are documents that the base rule rejects, so
    that rules describe what it leaves. Equal ids at the bound are taken in order of
    id and label; an id that repeats in either table counts as often as it is joined.
    """
    picked = labels.select(F.col("doc_id"), F.col("quality").alias(f"{OWN}y")).dropna().orderBy(F.xxhash64("doc_id"), "doc_id", f"{OWN}y").limit(max_labels)
    rows = (
        with_statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
        .select("doc_id", f"{OWN}y", f"{OWN}q.*")
        .where(f"not ({BASE_FAILED})")
        .select(F.expr(f"{OWN}y = 0").cast("int").alias("bad"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)).cast("int").alias("part"), *(F.expr(f"cast({e} as double)").alias(n) for n, e in FEATURES.items()))
        .collect()
    )
    # in an order of their own, whatever the tasks' order was
    return learn(sorted((r.asDict() for r in rows), key=lambda r: tuple(r.values())), **options)


BASE_FAILED = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"


def apply_rules(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus a struct ``quality`` with the statistics, ``base_failed``, ``rule`` and ``kept``.

    Rows are neither dropped nor merged: repeated rows get equal verdicts, a
    null text counts as empty and fails the base rule. A column ``quality`` of
    the input is replaced.
    """
    q = f"{OWN}q"
    flat = with_statistics(docs, text)
    inner = [F.col(f"{q}.{c}").alias(c) for c in STATS]
    # the rules read statistics by name, so they are evaluated on a struct whose fields have those names
    verdict = rules.verdict()
    named = flat.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(f"{OWN}d"), *inner)
    return (
        named.withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("rule", F.when(F.col("base_failed"), F.lit(0)).otherwise(verdict))
        .select(f"{OWN}d.*", F.struct(*STATS, "base_failed", "rule", F.col("rule").isNull().alias("kept")).alias("quality"))
        if "quality" not in docs.columns
        else apply_rules(docs.drop("quality"), rules, text)
    )
