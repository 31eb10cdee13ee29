"""Quality rules: a decision list learned from labelled documents, in DataFrame operations only.

``statistics`` measures each document. ``learn`` runs sequential covering on labelled statistics: a
rule starts empty, grows by the threshold condition of most information gain (FOIL) on the growing
part, is pruned on the other part, and is kept while it is precise there; rows that it covers leave
and the next rule follows. Every step is one aggregation to a histogram of (statistic, bin) with the
two labels' counts, whatever the number of rows. The list becomes one ordered Spark conditional
expression, so that applying it costs no join.

The fit reads at most ``max_labelled`` labelled documents, those with the smallest hash of their id;
everything else covers all documents.

Defined cases: null or empty text has no words and fails the base rule; nulls in labels are ignored and a
document labelled twice counts as poor if any label says so; without usable labels no rule is learned and only
the base rule decides; an empty table gives an empty result; a null id is judged like any other.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from factloom.llm.mixing import WORD
from factloom.operators.staging import Staging

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_chars")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(starts: Column) -> Column:
    """Words under the three-word windows at sorted starts."""
    gaps = lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda j: F.least(F.lit(3), F.get(p, j) - F.get(p, j - 1)))
    return _let(starts, lambda p: F.when(F.size(p) == 0, 0).when(F.size(p) == 1, 3).otherwise(F.aggregate(gaps(p), F.lit(3), lambda a, x: a + x)))


def _repeat_starts(hashes: Column) -> Column:
    """Sorted places of the values found twice or more."""
    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda p, j, d: F.coalesce(F.get(p, j)["h"] == F.get(p, j + d)["h"], F.lit(False))
    return _let(pairs, lambda p: F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda j: F.when(same(p, j, 1) | ((j > 0) & same(p, j, -1)), F.get(p, j)["i"])), lambda i: i.isNotNull())))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and the statistics of each text, as longs."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = docs.withColumn("_t", t).withColumns({"_w": F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)), "_l": F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))})
    grams = F.when(F.size("_w") < 3, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    second = first.withColumn("_g", grams)
    repeats = F.when(F.size(F.array_distinct("_g")) == F.size("_g"), 0).otherwise(_covered(_repeat_starts(F.col("_g"))))
    dropped = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    stats = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.translate("_t", SPACE, "")),
        "n_symbols": dropped(SYMBOLS),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_repeat_words": repeats,
        "n_lines": F.size("_l"),
        "n_upper": F.length(F.regexp_replace("_t", r"\P{Lu}+", "")),
        "n_digits": dropped("0123456789"),
        "n_marks": dropped("!?"),
        "n_chars": F.length("_t"),
    }
    return second.withColumns({k: v.cast("long") for k, v in stats.items()}).drop("_t", "_w", "_l", "_g")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """The ratios that rules may test, 0 where undefined."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "digit_share": per("n_digits", "word_chars"),
        "marks_per_word": per("n_marks", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self, columns: dict[str, Column]) -> Column:
        c = columns[self.feature]
        return c >= F.lit(self.threshold) if self.at_least else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def matches(rule: Rule, columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column(columns)
    return out


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that fires, from 1, or 0, as one conditional expression."""
    columns, out = features(), None
    for i, rule in enumerate(rules, 1):
        out = F.when(matches(rule, columns), i) if out is None else out.when(matches(rule, columns), i)
    return F.lit(0) if out is None else out.otherwise(0)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, max_labelled: int) -> DataFrame:
    """Statistics of the sampled labelled documents, with ``bad`` and ``part`` (0 and 1 grow, 2 prunes)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.min(label_col) == 0).cast("int").alias("bad"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)  # bounded by the parameter
    texts = docs.select(F.col(id_col).alias("_id"), "text").join(F.broadcast(sample), "_id")
    return statistics(texts).select("bad", F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(3)).alias("part"), *[c.alias(k) for k, c in features().items()])


def learn(table: DataFrame, bins: int = 32, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_covered: int = 5) -> list[Rule]:
    """The ordered rules that single out ``bad`` rows."""
    names = list(features())
    cols = {n: F.col(n) for n in names}
    steps = [i / bins for i in range(1, bins)]
    cut = table.agg(*[F.percentile_approx(n, steps, 10_000).alias(n) for n in names], *[F.percentile_approx(F.when(F.col("bad") == 1, F.col(n)), steps, 10_000).alias(f"bad_{n}") for n in names]).first()
    cuts = {n: sorted({*(cut[n] or ()), *(cut[f"bad_{n}"] or ())}) for n in names}
    table = table.withColumns({f"_b_{n}": sum((F.col(n) >= F.lit(float(v))).cast("int") for v in cuts[n]) + F.lit(0) for n in names})
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(f"_b_{n}").alias("b")) for n in names]))

    def histogram(where: Column) -> tuple[dict, int, int]:
        """Counts of good and bad rows by feature and bin among the growing rows."""
        got = table.where(where & (F.col("part") < 2)).select("bad", rows.alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        of = {n: {r["b"]: (r["p"], r["n"]) for r in got if r["f"] == n} for n in names}
        total = list(of[names[0]].values())
        return of, sum(p for p, _ in total), sum(n for _, n in total)

    def best(where: Column) -> tuple[float, Condition | None, int, int]:
        of, p0, n0 = histogram(where)
        found = (0.0, None, p0, n0)
        if not p0 or not n0:
            return found
        for n in names:
            hi_p, hi_n = p0, n0
            for j, v in enumerate(cuts[n]):
                p, q = of[n].get(j, (0, 0))
                hi_p, hi_n = hi_p - p, hi_n - q
                for at_least, a, b in ((True, hi_p, hi_n), (False, p0 - hi_p, n0 - hi_n)):
                    if a >= min_covered and (gain := a * (log2(a / (a + b)) - log2(p0 / (p0 + n0)))) > found[0] + 1e-9:
                        found = (gain, Condition(n, at_least, float(v)), a, b)
        return found

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_conditions:
            gain, condition, p, n = best(left & matches(rule, cols))
            if condition is None:
                break
            rule += (condition,)
            if n == 0:
                break
        if not rule:
            break
        held = table.where(left & (F.col("part") == 2))
        tests = [matches(rule[: i + 1], cols) for i in range(len(rule))]
        counts = held.agg(*[F.sum(F.when(m, F.col("bad")).otherwise(0)).alias(f"p{i}") for i, m in enumerate(tests)], *[F.sum(F.when(m, 1 - F.col("bad")).otherwise(0)).alias(f"n{i}") for i, m in enumerate(tests)]).first()
        scored = [((counts[f"p{i}"] or 0), (counts[f"n{i}"] or 0), i) for i in range(len(rule))]
        worth = lambda s: (s[0] - s[1]) / max(1, s[0] + s[1])
        p, n, i = max(scored, key=lambda s: (worth(s), -s[2]))
        if p + n == 0 or p / (p + n) < min_precision:
            break
        rules.append(rule[: i + 1])
        left = left & ~matches(rules[-1], cols)
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = 20_000, **options) -> list[Rule]:
    st = Staging(docs.sparkSession, "quality")
    table = st.write(labelled(docs, labels, id_col, label_col, max_labelled), "labelled")
    rules = learn(table, **options)
    st.drop(table)
    return rules


def _judged(docs: DataFrame, rules: list[Rule], text_col: str) -> DataFrame:
    """The columns of ``docs`` as ``c0``, ``c1`` ..., its statistics, ``base_failed``, ``rule`` and ``kept``."""
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    measured = statistics(inner, f"c{docs.columns.index(text_col)}")
    judged = measured.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with its statistics, ``base_failed``, ``rule`` (0: none) and ``kept``, which replace columns of these names."""
    new = (*STATS, "base_failed", "rule", "kept")
    return _judged(docs, rules, text_col).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in new], *new)


def accepted(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns whatever their names.

    The row number is there only because a filter isn't moved below a projection that holds one: moved, it would
    carry a copy of every statistic for each place that names it.
    """
    numbered = _judged(docs, rules, text_col).withColumn("_at", F.monotonically_increasing_id())
    return numbered.where(F.col("kept") & (F.col("_at") >= 0)).select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
