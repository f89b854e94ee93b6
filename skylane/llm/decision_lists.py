"""Quality rules: text statistics, and a decision list learned over them by sequential covering.

The statistics of a text are one SQL expression over its words and lines; nothing is exploded or
shuffled. The list is learned from labelled documents: a rule is grown on two thirds of them, one
threshold condition at a time by information gain, pruned on the last third to the prefix of its
conditions that does best there, and accepted if it is precise enough; then the documents that it
covers are set aside and the next rule is grown. Every growing step is one aggregation of all
remaining labelled rows by (feature, threshold interval). The list comes out as an ordered chain of
``when`` conditions, so that it is applied inside Spark like any other column.

Defined results: a null text has no words and fails; a document with a null or repeated id is judged by
its own text; labels that contradict each other for one id are left out of the training, as are labels
without a document; without labels, or where no rule is precise enough, the list is empty and only the
fixed limits count. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylane.llm.common import WHITE_CLASS, let, text_of
from skylane.session import written

WINDOW = 8
# The training set: so many labelled documents at most, those with the smallest hashes of their ids.
LABELLED_ROWS = 20_000
# Quantiles of each feature, of bad and of good rows; thresholds lie half-way between neighbouring ones of both.
QUANTILES = 15
MOST_RULES = 8
MOST_CONDITIONS = 4
# A rule must be this precise on the rows that it was pruned on, and cover so many bad ones there.
PRECISION = 0.97
LEAST_COVERED = 3


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of ``WINDOW`` words that occur twice or more; windows are compared by 64-bit hashes."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(_covered(w)))
    return F.when(F.size(words) > WINDOW, found).otherwise(0)


def _covered(windows: Column) -> Column:
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))

    def twice(s: Column) -> Column:
        def same(p: Column, q: Column) -> Column:
            return F.coalesce(q["hash"] == p["hash"], F.lit(False))

        kept = F.filter(s, lambda p, i: same(p, F.get(s, i - 1)) | same(p, F.get(s, i + 1)))
        return F.sort_array(F.transform(kept, lambda p: p["at"]))

    return F.aggregate(
        let(placed, twice),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda acc, at: F.struct(
            (at + WINDOW).alias("end"), (acc["total"] + F.least(F.lit(WINDOW), at + WINDOW - acc["end"])).alias("total")
        ),
        lambda acc: acc["total"],
    )


def statistics(text: Column) -> Column:
    """A struct of the statistics of one non-null text."""

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")
        )

    words = let(F.array_remove(F.split(text, WHITE_CLASS + "+"), ""), of_words)
    lines = let(F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    return F.struct(
        words.alias("words"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("n_calls"),
    )


def _columns(s: Column) -> list[Column]:
    return [
        s["words"]["n_words"].alias("n_words"),
        s["words"]["word_chars"].alias("word_chars"),
        s["n_symbols"].alias("n_symbols"),
        s["lines"]["n_dup_lines"].alias("n_dup_lines"),
        s["words"]["n_repeat_words"].alias("n_repeat_words"),
    ]


def features(s: Column) -> dict[str, Column]:
    """What rules may test; shares are of words, lines or characters."""

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    words, chars = s["words"]["n_words"], s["words"]["word_chars"]
    return {
        "words": words.cast("double"),
        "chars_per_word": share(chars, words),
        "symbols_per_word": share(s["n_symbols"], words),
        "upper_share": share(s["n_upper"], chars),
        "calls_per_word": share(s["n_calls"], words),
        "dup_line_share": share(s["lines"]["n_dup_lines"], s["lines"]["n_lines"]),
        "repeat_share": share(s["words"]["n_repeat_words"], words),
    }


def base_failed(s: Column) -> Column:
    words = s["words"]
    return (words["n_words"] < 20) | (words["n_repeat_words"] * 100 > words["n_words"] * 30)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    step: int  # place of the threshold among those of its feature

    def on(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value > F.lit(self.threshold) if self.above else value <= F.lit(self.threshold)

    def on_steps(self) -> Column:
        value = F.col(self.feature)
        return value > self.step if self.above else value <= self.step

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]

    def keeps(self, values: dict[str, Column]) -> Column:
        """The verdict: the first rule that holds rejects."""
        verdict = None
        for rule in self.rules:
            holds = _all([c.on(values) for c in rule])
            verdict = F.when(holds, F.lit(False)) if verdict is None else verdict.when(holds, F.lit(False))
        return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) or "keep all"


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def training_rows(docs: DataFrame, labels: DataFrame, most: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, bad and the features of the labelled documents that do not fail the fixed limits."""
    agreed = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    agreed = agreed.agg(F.min("quality").alias("low"), F.max("quality").alias("high")).filter("low = high")
    chosen = agreed.select("doc_id", (F.col("low") == 0).alias("bad")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most ``most`` rows, so the documents need no shuffle.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "bad", statistics(F.col("text")).alias("s"))
    return rows.filter(~base_failed(F.col("s"))).select("doc_id", "bad", *[v.alias(k) for k, v in features(F.col("s")).items()])


def fit(rows: DataFrame, precision: float = PRECISION) -> DecisionList:
    """Learn a list from doc_id, bad (boolean) and numeric features."""
    rows = written(rows, "labelled")
    names = [c for c in rows.columns if c not in ("doc_id", "bad")]
    shares = [i / (QUANTILES - 1) for i in range(QUANTILES)]
    cuts = rows.groupBy("bad").agg(*[F.percentile_approx(n, shares, 10_000).alias(n) for n in names]).collect()
    seen = {n: sorted({v for r in cuts for v in r[n] or []}) for n in names}
    thresholds = {n: [(a + b) / 2 for a, b in zip(values, values[1:])] for n, values in seen.items()}

    def step(name: str) -> Column:
        # The number of thresholds below the value: value > thresholds[k] exactly if step > k.
        return F.size(F.filter(F.array(*map(F.lit, thresholds[name])), lambda t: F.col(name) > t)) if thresholds[name] else F.lit(0)

    third = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3))
    left = written(rows.select("bad", (third == 0).alias("held_out"), *[step(n).alias(n) for n in names]), "steps")
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        rule = _pruned(left, _grown(left, names, thresholds), precision)
        if not rule:
            break
        rules.append(rule)
        left = left.filter(~_all([c.on_steps() for c in rule]))
    return DecisionList(tuple(rules))


def _grown(left: DataFrame, names: list[str], thresholds: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        covered = left.filter(~F.col("held_out") & _all([c.on_steps() for c in rule]))
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("step")) for n in names]))
        counts = covered.select("bad", each.alias("e")).groupBy("e.feature", "e.step")
        # At most (features) x 2 x QUANTILES rows.
        found = counts.agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
        best: tuple[float, Condition | None] = (1e-9, None)
        bad = sum(r["bad"] for r in found if r["feature"] == names[0])
        good = sum(r["good"] for r in found if r["feature"] == names[0])
        if not bad or not good:
            break
        before = math.log2(bad / (bad + good))
        for n in names:
            by_step = {r["step"]: (r["bad"], r["good"]) for r in found if r["feature"] == n}
            p = q = 0
            for k, threshold in enumerate(thresholds[n]):
                p += by_step.get(k, (0, 0))[0]
                q += by_step.get(k, (0, 0))[1]
                for above, b, g in ((True, bad - p, good - q), (False, p, q)):
                    if b:
                        gain = b * (math.log2(b / (b + g)) - before)
                        if gain > best[0]:
                            best = (gain, Condition(n, above, threshold, k))
        if best[1] is None:
            break
        rule += (best[1],)
    return rule


def _pruned(left: DataFrame, rule: Rule, precision: float) -> Rule:
    """The prefix of the rule that does best on the rows held out, or nothing if none is precise enough."""
    if not rule:
        return ()
    sums = []
    for k in range(1, len(rule) + 1):
        holds = _all([c.on_steps() for c in rule[:k]])
        sums += [F.count_if(F.col("bad") & holds).alias(f"bad{k}"), F.count_if(~F.col("bad") & holds).alias(f"good{k}")]
    row = left.filter("held_out").agg(*sums).first()
    best: tuple[float, Rule] = (-1.0, ())
    for k in range(1, len(rule) + 1):
        bad, good = row[f"bad{k}"], row[f"good{k}"]
        if bad >= LEAST_COVERED and bad >= precision * (bad + good):
            # Covered bad rows, less a price for covered good ones.
            worth = bad - good / max(1e-9, 1 - precision)
            if worth > best[0]:
                best = (worth, rule[:k])
    return best[1]


def judge(docs: DataFrame, learned: DecisionList) -> DataFrame:
    """Per document: doc_id, the statistics, base_failed and kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(text_of(), lambda t: statistics(t)).alias("s"))
    s = F.col("s")
    return rows.select(
        "doc_id", *_columns(s), base_failed(s).alias("base_failed"), (~base_failed(s) & learned.keeps(features(s))).alias("kept")
    )


def only_kept(docs: DataFrame, learned: DecisionList) -> DataFrame:
    """The rows that are kept, with all their columns."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.filter(let(let(text, statistics), lambda s: ~base_failed(s) & learned.keeps(features(s))))
