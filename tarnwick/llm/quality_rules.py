"""Quality rules: decision lists learned by sequential covering, applied as Spark expressions.

Statistics of the texts are built-in Spark expressions.  From a bounded sample of labelled documents
rules are grown one after another, each a conjunction of thresholds that covers bad documents; it is
pruned on rows that it wasn't grown on, and the rows that it covers are taken away.  The list becomes
one CASE WHEN expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kept(text: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{keep}]++", ""))


_CLASSES = {"symbols": "#$%&*+<=>@^_`~\\\\{}\\[\\]\\/", "bars": "|", "bangs": "!?", "capitals": "A-ZÀ-Þ", "digits": "0-9"}


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct stats of numbers about the text, all in whole-stage code; null for a null text.

    Ratios of an empty text are 0.  A text is rewritten once, to the few characters of any class, and the
    classes are counted in what is left.  A column of docs named stats is replaced.
    """
    text = F.col(text_col)
    rest = F.regexp_replace(text, f"[^{''.join(_CLASSES.values())}]++", "")
    words = F.filter(F.split(text, "[ \\n\\t\\r\\f]+"), lambda w: w != "")
    base = docs.withColumn("stats", F.struct(F.length(text).alias("n"), F.regexp_count(text, F.lit("\\n")).alias("breaks"), words.alias("words"), rest.alias("rest")))
    n, words, rest = F.greatest(F.col("stats.n"), F.lit(1)).cast("double"), F.col("stats.words"), F.col("stats.rest")
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    fields = [F.col("stats.n").cast("double").alias("chars"), F.size(words).cast("double").alias("words"), (n / count).alias("word_length"), (F.size(F.array_distinct(words)) / count).alias("distinct_words"), (F.col("stats.breaks") / n).alias("breaks")]
    fields += [(_kept(rest, c) / n).alias(k) for k, c in _CLASSES.items()]
    return base.withColumn("stats", F.when(text.isNotNull(), F.struct(*fields)))


FEATURES = ("chars", "words", "word_length", "distinct_words", "breaks", "symbols", "bars", "bangs", "capitals", "digits")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, stats: str = "stats") -> Column:
        c = F.col(f"{stats}.{self.feature}")
        return c > self.threshold if self.above else c <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _best_condition(x: dict[str, np.ndarray], y: np.ndarray) -> tuple[float, Condition | None]:
    """The threshold of greatest FOIL gain over all distinct values of all features; ties go to the first."""
    p0, n0 = int(y.sum()), int((~y).sum())
    best: tuple[float, Condition | None] = (1e-9, None)
    base = np.log2(p0 / (p0 + n0))
    for f, v in x.items():
        order = np.argsort(v, kind="stable")
        s, pos = v[order], np.cumsum(y[order])
        cut = np.flatnonzero(s[1:] > s[:-1])
        if not len(cut):
            continue
        p_low, all_low = pos[cut], cut + 1
        for above, p, n in ((False, p_low, all_low), (True, p0 - p_low, len(v) - all_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / n) - base), -1)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), Condition(f, above, float((s[cut[k]] + s[cut[k] + 1]) / 2)))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, min_precision: float = 0.95, min_cover: int = 3, seed: int = 5) -> list[Rule]:
    """Ordered rules for bad rows; what no rule covers is good.

    Each rule is grown on two thirds of the rows that are left until it covers no good row or no threshold
    gains, then loses its last conditions as long as that raises (p - n) / (p + n) on the other third.  Learning ends with
    the first rule whose precision over all rows left is below min_precision, or which covers fewer than
    min_cover.  Rows with a statistic that is not finite are left out; without rows of both kinds there is no rule.
    """
    fine = np.all([np.isfinite(v) for v in x.values()], 0) if x else np.zeros(0, bool)
    x, bad = {k: v[fine] for k, v in x.items()}, np.asarray(bad, bool)[fine]
    r = np.random.default_rng(seed)
    rules: list[Rule] = []
    take = lambda rows: {k: v[rows] for k, v in x.items()}
    left = np.arange(len(bad))
    while bad[left].any() and not bad[left].all():
        mixed = r.permutation(left)
        kinds = [mixed[bad[mixed]], mixed[~bad[mixed]]]
        grow = np.sort(np.concatenate([k[: -(-2 * len(k) // 3)] for k in kinds]))
        prune = np.sort(np.concatenate([k[-(-2 * len(k) // 3) :] for k in kinds]))
        rule: Rule = ()
        own = grow
        while not bad[own].all():
            _, c = _best_condition(take(own), bad[own])
            if c is None:
                break
            rule += (c,)
            own = own[c.holds(take(own))]

        def worth(k: int) -> float:
            hit = covers(rule[:k], take(prune))
            p, n = int((hit & bad[prune]).sum()), int((hit & ~bad[prune]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        if not rule:
            break
        rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]
        hit = covers(rule, take(left))
        if hit.sum() < min_cover or bad[left][hit].mean() < min_precision:
            break
        rules.append(rule)
        left = left[~hit]
    return rules


def learn_from(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> list[Rule]:
    """Rules from the statistics of at most max_rows labelled documents, those of the least id hash.

    A document is bad where a label of it is 0, also if another is not; labels that are null, or without a
    document, are left out.  Of rows that repeat an id the text that sorts first is taken.  Empty tables
    give no rule.
    """
    sample = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label")).dropna().groupBy("__id").agg(F.min(F.col("__label") != 0).alias("__good"))
    sample = sample.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    own = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("__text")).where("__text is not null").join(F.broadcast(sample), F.col("__own") == F.col("__id"))
    own = own.groupBy("__id", "__good").agg(F.min("__text").alias("__text"))
    rows = statistics(own, "__text").select("__id", "__good", *(F.col(f"stats.{f}").alias(f) for f in FEATURES)).toPandas().sort_values("__id")
    return learn({f: rows[f].to_numpy(float) for f in FEATURES}, ~rows["__good"].to_numpy(bool), **options)


def rule_column(rules: list[Rule], stats: str = "stats") -> Column:
    """Number of the first rule that holds, from 1; 0 where none does; -1 for a null text."""
    out = F.when(F.col(stats).isNull(), F.lit(-1))
    for k, rule in enumerate(rules, 1):
        held = rule[0].column(stats)
        for c in rule[1:]:
            held = held & c.column(stats)
        out = out.when(held, F.lit(k))
    return out.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs with the columns stats, rule (see rule_column) and keep, which is rule = 0.

    So a null text goes, and an empty one is judged by its statistics, which are 0; a very long text is
    judged whole, like any other; rows that repeat are judged alike; columns of docs that are named stats,
    rule or keep are replaced, all others stay; an empty table stays empty.
    """
    return statistics(docs, text_col).withColumn("rule", rule_column(rules)).withColumn("keep", F.col("rule") == 0)
