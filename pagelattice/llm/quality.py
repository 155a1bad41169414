"""Quality rules as a short-circuit cascade (operator 2), in DataFrame functions only.

A rule says of a text's features when the text is rejected.  One pass over a sample, with the
clock read between the features of each text, gives every feature's cost (time a text) and every
rule's selectivity (share it rejects); rules are ordered by rejection per cost.  The cascade is one CASE
expression in that order: what a later rule needs is not computed for a text that an earlier one rejected.
Words are found once a text, and the base figures, where they are asked for, come first, so that
of rejected texts the method's own figures are never computed.  The order changes the time, never the verdict.

Defined results: a null text has no words and is rejected like an empty one; repeated
rows are judged alike; an empty table gives an empty table and the rules' given order;
extra columns stay, but in ``cascade`` those named like its results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Texts in the sample that costs and selectivities are estimated on, and its share that only warms up.
SAMPLE_ROWS, WARM = 500, 0.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(found: Column) -> Column:
    """Words that lie in a window of 8 found twice or more; windows are compared by 64-bit hashes."""

    def covered(sorted_: Column) -> Column:
        last = F.size(sorted_) - 1
        twin = lambda k: ((k > 0) & (F.get(sorted_, k)["x"] == F.get(sorted_, k - 1)["x"])) | ((k < last) & (F.get(sorted_, k)["x"] == F.get(sorted_, k + 1)["x"]))
        places = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), twin), lambda k: F.get(sorted_, k)["i"]))
        start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["at"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    def of_windows(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(pairs), covered))

    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))
    return F.when(F.size(found) <= WINDOW, 0).otherwise(let(F.transform(found, lambda w: F.xxhash64(w)), lambda h: let(windows(h), of_windows))).cast("long")


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0)


def stutters(found: Column) -> Column:
    """Words equal to the one before."""
    return F.size(F.filter(found, lambda w, i: (i > 0) & (w == F.get(found, i - 1)))).cast("long")


#: Features of a text, each from the text and its words.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.concat_ws("", w)).cast("long"),
    "n_symbols": lambda t, w: F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
    "n_capitals": lambda t, w: F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
    "n_lines": lambda t, w: F.size(lines(t)).cast("long"),
    "n_dup_lines": lambda t, w: let(lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_stutter": lambda t, w: stutters(w),
    "n_repeat_words": lambda t, w: repeated_words(w),
}
#: The figures that are asked for of every text.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]  # of the features it needs


def base_rules(min_words: int) -> tuple[Rule, ...]:
    return (Rule("few_words", ("n_words",), lambda n: n < min_words), Rule("repeats", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 30 * n))


#: The method's own rules; a text is kept if neither they nor the base rules reject it.
OWN_RULES = (
    Rule("stutter", ("n_stutter", "n_words"), lambda s, n: 100 * s > 30 * n),
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > 3 * n),
    Rule("shouting", ("n_capitals", "word_chars"), lambda c, w: 10 * c > 4 * w),
    Rule("long_words", ("word_chars", "n_words"), lambda w, n: w > 40 * n),
    Rule("same_lines", ("n_dup_lines", "n_lines"), lambda d, n: (n >= 5) & (10 * d > 6 * n)),
)
BASE_RULES = base_rules(20)
RULES = (*BASE_RULES, *OWN_RULES)


def clock() -> Column:
    """Nanoseconds, read when the expression is evaluated."""
    return F.reflect(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")


def estimate(docs: DataFrame, rules=RULES, rows: int = SAMPLE_ROWS, given: tuple[str, ...] = ()) -> list[dict]:
    """Of every rule its cost (seconds a text, for features that are not given) and selectivity on a sample, best rejection per cost first.

    One job: a text's features are fields of one struct, evaluated in turn, each followed by a reading of the clock.
    """
    rules = list(rules)
    scratch = Scratch(docs.sparkSession, "quality")
    share = min(1.0, 1.5 * rows / max(1, docs.count()))
    text = F.coalesce("text", F.lit(""))
    picked = docs.select(text.alias("text")).sample(share, seed=17).limit(rows).coalesce(1)
    sample = scratch.table(picked.withColumn("words", words(F.col("text"))), "sample")
    needed = list(dict.fromkeys(x for r in rules for x in r.needs))
    fields = [clock().alias("t0")]
    for k, x in enumerate(needed, 1):
        fields += [FEATURES[x](F.col("text"), F.col("words")).alias(x), clock().alias(f"t{k}")]
    seen = sample.select(F.monotonically_increasing_id().alias("at"), F.struct(*fields).alias("f"))
    warm = F.col("at") >= int(WARM * rows)
    costs = [F.coalesce(F.avg(F.when(warm, F.col(f"f.t{k}") - F.col(f"f.t{k - 1}"))), F.avg(F.col(f"f.t{k}") - F.col(f"f.t{k - 1}")), F.lit(0.0)).alias(f"c{k}") for k in range(1, len(needed) + 1)]
    shares = [F.coalesce(F.avg(r.rejects(*[F.col(f"f.{x}") for x in r.needs]).cast("double")), F.lit(0.0)).alias(f"s{k}") for k, r in enumerate(rules)]
    got = seen.agg(*costs, *shares).first()
    cost = {x: got[f"c{k}"] / 1e9 for k, x in enumerate(needed, 1)}
    found = [{"rule": r, "cost": sum(cost[x] for x in r.needs if x not in given), "rejected": got[f"s{k}"]} for k, r in enumerate(rules)]
    return sorted(found, key=lambda x: -x["rejected"] / max(x["cost"], 1e-9))


def rejected_by(text: Column, found: Column, rules, given: dict[str, Column] | None = None) -> Column:
    """The first rule in order that rejects, else null; features not given are computed when a rule asks for them."""
    out = F.lit(None).cast("string")
    for rule in reversed(list(rules)):
        values = [given[x] if given and x in given else FEATURES[x](text, found) for x in rule.needs]
        out = F.when(rule.rejects(*values), F.lit(rule.name)).otherwise(out)
    return out


def verdict(text: Column, rules) -> Column:
    """The rule that rejects a text, else null."""
    text = F.coalesce(text, F.lit(""))
    return let(words(text), lambda w: rejected_by(text, w, rules))


def passing(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    ordered = [x["rule"] for x in estimate(docs, rules)]
    return docs.where(verdict(F.col("text"), ordered).isNull())


def cascade(docs: DataFrame, base=BASE_RULES, own=OWN_RULES) -> DataFrame:
    """Adds to docs the figures of BASE, base_failed, rejected_by (the rule, null if kept) and kept.

    The base figures are computed of every text, those of the own rules only of texts that the base rules
    and the own rules before them pass.
    """
    ordered = [x["rule"] for x in estimate(docs, own, given=BASE)]
    text = F.coalesce("text", F.lit(""))

    def judged(found: Column, figures: Column) -> Column:
        given = {x: figures[x] for x in BASE}
        failed = rejected_by(text, found, base, given)
        verdict = F.when(failed.isNotNull(), failed).otherwise(rejected_by(text, found, ordered, given))
        return F.struct(*[given[x].alias(x) for x in BASE], failed.isNotNull().alias("base_failed"), verdict.alias("rejected_by"))

    figures = lambda w: F.struct(*[FEATURES[x](text, w).alias(x) for x in BASE])
    got = docs.select(F.struct("*").alias("doc"), let(words(text), lambda w: let(figures(w), lambda f: judged(w, f))).alias("got"))
    names = [*BASE, "base_failed", "rejected_by"]
    kept = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in {*names, "kept"}]
    return got.select(*kept, *[F.col(f"got.{x}").alias(x) for x in names], F.col("got.rejected_by").isNull().alias("kept"))
