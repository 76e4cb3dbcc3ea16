"""Quality rules: counts of each text, and a learned decision list of threshold conjunctions.

The counts are column expressions over one row. Sequential covering learns the list:
thresholds are quantiles of each measure over the labelled rows; each step of growing is one
aggregate of (measure, threshold, label) counts over the rows that the rule so far selects
and earlier rules do not, and takes the condition of highest information gain; a rule is then
pruned to the prefix that is best on a fold it was not grown on, and joins the list only if
it is precise there. The list ends as one ordered conditional expression. DataFrame
functions only; the driver sees bounded tables of counts.

Defined cases: a null or empty text has no words and fails the base rules; a measure whose
divisor is zero is 0; rows without a label do not train, and of several labels of an id the
lowest counts; without labelled rows of both kinds the list is empty and only the base rules
decide; a null id is kept; repeated rows give repeated results; an empty table gives an
empty result. The words of a very long text are arrays of one row. Other columns do not matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import SPACES, materialize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_full_lines", "n_upper", "n_bang", "n_distinct"]


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the counts of each text."""
    has_word = lambda line: F.btrim(line, F.lit(SPACES)) != ""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("inner", F.btrim("body", F.lit(SPACES))).withColumn(
        "words", F.when(F.col("inner") != "", F.split("inner", r"[\x20\x09-\x0D]+", -1))
        .otherwise(F.array().cast("array<string>")),
    ).withColumn("lines", F.filter(F.split("body", "\n", -1), has_word))
    # A window of three words is known by its 64-bit hash and start.
    three = F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda i: F.struct(
            F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p")
        ),
    )
    rows = rows.withColumn("spans", F.when(F.size("words") >= 3, F.sort_array(three)))
    rows = rows.withColumn("starts", F.sort_array(F.transform(_repeated(), lambda s: s["p"])))
    covered = F.aggregate(
        F.transform(
            F.col("starts"),
            lambda p, j: F.least(F.lit(3), F.coalesce(F.get("starts", j + 1), p + 3) - p),
        ),
        F.lit(0).cast("long"), lambda acc, n: acc + n,
    )
    left = lambda pattern: F.length(F.regexp_replace("body", pattern, "")).cast("long")
    return rows.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_full_lines"),
        left("[^A-Z]+").alias("n_upper"),
        left("[^!]+").alias("n_bang"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


def _repeated() -> Column:
    """Windows whose hash a neighbour in hash order shares."""
    before = lambda j: F.get("spans", j - 1)["h"]
    after = lambda j: F.get("spans", j + 1)["h"]
    return F.filter(
        F.col("spans"),
        lambda s, j: F.coalesce(s["h"] == before(j), F.lit(False)) | F.coalesce(s["h"] == after(j), F.lit(False)),
    )


def measures() -> dict[str, Column]:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": ratio("word_chars", "n_words"),
        "symbol_share": ratio("n_symbols", "word_chars"),
        "dup_line_share": ratio("n_dup_lines", "n_full_lines"),
        "repeat_share": ratio("n_repeat_words", "n_words"),
        "upper_share": ratio("n_upper", "word_chars"),
        "bang_share": ratio("n_bang", "n_words"),
        "distinct_share": ratio("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: int  # index of the threshold
    value: float

    def on_bins(self) -> Column:
        b = F.col(f"b_{self.measure}")
        return b > self.cut if self.above else b <= self.cut

    def on_values(self) -> Column:
        return F.col(f"m_{self.measure}") > self.value if self.above else F.col(f"m_{self.measure}") <= self.value

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.value:g}"


@dataclass
class Rule:
    conditions: list[Condition] = field(default_factory=list)
    precision: float = 0.0

    def all(self, how: str) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & getattr(c, how)()
        return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    if p <= 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn_list(
    labelled: DataFrame,
    bins: int = 32,
    max_rules: int = 8,
    max_conditions: int = 4,
    min_precision: float = 0.95,
    min_cover: int = 5,
) -> list[Rule]:
    """Rules for ``bad`` rows, in order. ``labelled`` has the counts, ``bad`` (bool) and ``fold`` (true: prune)."""
    columns = measures()
    rows = labelled.select("bad", "fold", *(c.alias(f"m_{m}") for m, c in columns.items()))
    quantiles = rows.agg(
        *(F.percentile_approx(f"m_{m}", [i / bins for i in range(1, bins)], 2000).alias(m) for m in columns)
    ).first()
    cuts = {m: sorted(set(quantiles[m] or [])) for m in columns}
    binned = materialize(
        rows.select(
            "bad", "fold",
            *(
                sum(((F.col(f"m_{m}") > t).cast("int") for t in cuts[m]), F.lit(0)).alias(f"b_{m}")
                for m in columns
            ),
        ).groupBy("bad", "fold", *(f"b_{m}" for m in columns)).agg(F.count("*").alias("w")),
        "rule-cells",
    )
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule, selected = Rule(), left
        while len(rule.conditions) < max_conditions:
            counts = (
                binned.filter(selected & ~F.col("fold"))
                .select("bad", "w", F.explode(F.array(*(
                    F.struct(F.lit(m).alias("m"), F.col(f"b_{m}").alias("b")) for m in columns
                ))).alias("x"))
                .groupBy("x.m", "x.b", "bad").agg(F.sum("w").alias("w")).collect()
            )
            table: dict[str, list[list[int]]] = {m: [[0, 0] for _ in range(len(cuts[m]) + 1)] for m in columns}
            for r in counts:
                table[r["m"]][r["b"]][0 if r["bad"] else 1] += r["w"]
            p0, n0 = (sum(cell[i] for cell in next(iter(table.values()))) for i in (0, 1))
            if p0 < min_cover or n0 == 0:
                break
            best, most = None, 0.0
            for m, cells in table.items():
                p = n = 0
                for cut, (a, b) in enumerate(cells[:-1]):
                    p, n = p + a, n + b
                    for above, (x, y) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        gain = _gain(x, y, p0, n0)
                        if x >= min_cover and gain > most + 1e-9:
                            best, most = Condition(m, above, cut, float(cuts[m][cut])), gain
            if best is None:
                break
            rule.conditions.append(best)
            selected = selected & best.on_bins()
        if not rule.conditions:
            break
        sums = []
        for k in range(1, len(rule.conditions) + 1):
            prefix = Rule(rule.conditions[:k]).all("on_bins")
            sums += [
                F.sum(F.when(prefix & F.col("bad"), F.col("w"))).alias(f"p{k}"),
                F.sum(F.when(prefix & ~F.col("bad"), F.col("w"))).alias(f"n{k}"),
            ]
        held = binned.filter(left & F.col("fold")).agg(*sums).first()
        worth = []
        for k in range(1, len(rule.conditions) + 1):
            p, n = held[f"p{k}"] or 0, held[f"n{k}"] or 0
            worth.append(((p - n) / (p + n) if p + n else -1.0, -k, p / (p + n) if p + n else 0.0, p))
        _, k, precision, p = max(worth)
        rule = Rule(rule.conditions[:-k], precision)
        if precision < min_precision or p < 1:
            break
        rules.append(rule)
        left = left & ~rule.all("on_bins")
    return rules


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(counts: DataFrame, rules: list[Rule], id_col: str = "doc_id") -> DataFrame:
    """Counts, ``base_failed``, ``rule`` (text of the first rule that rejects, or null) and ``kept``."""
    with_measures = counts.select("*", *(c.alias(f"m_{m}") for m, c in measures().items()))
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.all("on_values"), F.lit(" and ".join(map(str, rule.conditions)))).otherwise(verdict)
    return with_measures.select(
        id_col, *COUNTS, base_failed().alias("base_failed"), verdict.alias("rule"),
        (~base_failed() & verdict.isNull()).alias("kept"),
    )


def labelled_counts(counts: DataFrame, labels: DataFrame, train: Column, prune: Column, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``counts`` that ``train`` selects, with ``bad`` from ``labels.quality`` and the ``fold``."""
    known = labels.select(F.col(id_col).alias("label_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("quality IS NOT NULL").groupBy("label_id").agg(F.min("quality").alias("quality"))
    return counts.filter(train).join(known, F.col(id_col) == F.col("label_id")).select(
        *COUNTS, *MORE, (F.col("quality") == 0).alias("bad"), prune.alias("fold")
    )


def quality(docs: DataFrame, labels: DataFrame, train: Column, prune: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge every row by the base rules and a list learned from the labelled rows that ``train`` selects."""
    counts = materialize(text_counts(docs, id_col, text_col), "text-counts")
    return judge(counts, learn_list(labelled_counts(counts, labels, train, prune, id_col)), id_col)
