"""Quality rules: text statistics and a learned decision list, in built-in SQL functions only.

Statistics are one pass over a text with array functions. The list is learned by
sequential covering: on labelled rows, a rule (a conjunction of thresholds) is grown on
two thirds by information gain, pruned from its end on the last third, accepted if it is
precise enough there, and its rows are taken away before the next rule. The rules become
one ordered ``CASE WHEN`` expression. The fit uses at most ``fit_rows`` labelled rows
(those with the smallest hash of their id), everything else runs over all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equityspark.llm import common

FIT_ROWS = 20_000
SPACE = r"[\\x20\\x09-\\x0D]+"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_distinct"]
RATES = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "distinct_rate"]


def _let(value: str, name: str, body: str) -> str:
    """Bind ``value`` to a lambda variable, so that it is computed once per row."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns ``COUNTS`` (long) to every row; null and empty texts have zeros.

    Words are runs of characters other than ASCII white space. ``n_repeat_words`` counts the
    words inside 3-word windows found twice or more in the text; windows are sorted with
    their positions, so the work is n log n in the words of one text.
    """
    t = f"coalesce(`{text}`, '')"
    repeats = _let(
        "sort_array(transform(sequence(0, size(w) - 3), i -> named_struct('h', xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), 'i', i)))", "s",
        _let("sort_array(transform(filter(s, (x, j) -> x.h <=> get(s, j - 1).h OR x.h <=> get(s, j + 1).h), x -> x.i))", "p",
             "aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1) - x, 3))), 0L, (a, b) -> a + b)"))
    lines = _let(f"filter(split({t}, '\\n', -1), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')", "l", "named_struct('n', size(l), 'd', size(l) - size(array_distinct(l)))")
    stats = _let(f"array_remove(split({t}, '{SPACE}', -1), '')", "w", f"""named_struct(
        'n_words', CAST(size(w) AS BIGINT),
        'word_chars', aggregate(w, 0L, (a, x) -> a + length(x)),
        'n_symbols', CAST(length({t}) - length(translate({t}, '#*$%&|<>', '')) AS BIGINT),
        'lines', {lines},
        'n_repeat_words', CASE WHEN size(w) < 4 THEN 0L ELSE {repeats} END,
        'n_upper', CAST(length({t}) - length(regexp_replace({t}, '\\\\p{{Lu}}+', '')) AS BIGINT),
        'n_marks', CAST(length({t}) - length(translate({t}, '!?', '')) AS BIGINT),
        'n_distinct', CAST(size(array_distinct(w)) AS BIGINT))""")
    df = docs.drop(*[c for c in COUNTS if c != text]).withColumn("_s", F.expr(stats))
    plain = {c: F.col(f"_s.{c}") for c in COUNTS if c not in ("n_dup_lines", "n_lines")}
    df = df.withColumns({**plain, "n_dup_lines": F.col("_s.lines.d").cast("long"), "n_lines": F.col("_s.lines.n").cast("long")})
    return df.drop("_s")


def rates() -> dict[str, Column]:
    """The statistics that rules test, from the columns ``COUNTS``; never null."""
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"), "mean_word": per("word_chars", "n_words"), "symbol_rate": per("n_symbols", "n_words"),
        "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"), "upper_rate": per("n_upper", "word_chars"),
        "mark_rate": per("n_marks", "n_words"), "distinct_rate": per("n_distinct", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


Rule = list[tuple[str, str, float]]


def _covers(rule: Rule, row: dict) -> bool:
    return all(row[f] > t if op == ">" else row[f] <= t for f, op, t in rule)


def _cuts(values: list[float], most: int = 48) -> list[float]:
    """Midpoints between neighbouring distinct values, thinned evenly to ``most``."""
    v = sorted(set(values))
    mid = [(a + b) / 2 for a, b in zip(v[:-1], v[1:], strict=True)]
    step = max(1, -(-len(mid) // most))
    return sorted({*mid[::step], *mid[-1:]})


def grow(rows: list[dict], features: list[str], most: int = 4) -> Rule:
    """Conjunction grown by information gain for rows labelled bad."""
    rule: Rule = []
    while len(rule) < most:
        p0, n0 = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for f in features:
            order = sorted(rows, key=lambda r: r[f])
            cuts, at, p, n = _cuts([r[f] for r in rows]), 0, 0, 0
            for t in cuts:
                while at < len(order) and order[at][f] <= t:
                    p, n, at = p + order[at]["bad"], n + (not order[at]["bad"]), at + 1
                for op, a, b in (("<=", p, n), (">", p0 - p, n0 - n)):
                    if a:
                        g = a * (math.log2(a / (a + b)) - math.log2(p0 / (p0 + n0)))
                        if g > gain:
                            best, gain = (f, op, t), g
        if best is None:
            break
        rule.append(best)
        rows = [r for r in rows if _covers([best], r)]
    return rule


def prune(rule: Rule, rows: list[dict]) -> Rule:
    """Prefix of the rule with the best precision (with prior counts) on rows it was not grown on; ties: the shorter."""

    def worth(k: int) -> float:
        hit = [r["bad"] for r in rows if _covers(rule[:k], r)]
        return (sum(hit) + 0.5) / (len(hit) + 1.5)

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(rows: list[dict], features: list[str], min_precision: float = 0.97, min_cover: int = 3, max_rules: int = 16) -> list[Rule]:
    """Ordered rejecting rules from rows with ``features`` and ``bad``; no rows give no rules."""
    growing, pruning = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < max_rules and any(r["bad"] for r in growing):
        rule = prune(grow(growing, features), pruning)
        hit = [r["bad"] for r in [*growing, *pruning] if rule and _covers(rule, r)]
        if len(hit) < min_cover or sum(hit) < min_precision * len(hit):
            break
        rules.append(rule)
        growing = [r for r in growing if not _covers(rule, r)]
        pruning = [r for r in pruning if not _covers(rule, r)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from documents with a ``quality`` label (1 good, 0 bad; null rows are left out).

    ``fit_rows`` bounds the labelled rows used, and so what is broadcast and collected. The
    labelled texts are written first: their statistics alone are computed, not the corpus's.
    Of rows that repeat an id, and of labels that do, one stays (the smaller statistics, the worse label).
    """
    some = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    seen = counts(common.written(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "labelled"))
    named = rates()
    stats = F.struct(base_failed().alias("failed"), *[c.alias(n) for n, c in named.items()])
    got = seen.groupBy("doc_id", "bad").agg(F.min(stats).alias("s")).select("doc_id", "bad", "s.*").toArrow().to_pylist()
    rows = sorted((r for r in got if not r.pop("failed")), key=lambda r: (hash((r["doc_id"], 7)), r["doc_id"], r["bad"]))
    return learn(rows, list(named))


def decision(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects; the first rule that covers a row decides."""
    named = rates()
    if not rules:
        return F.lit(True)
    case = None
    for rule in rules:
        test = F.lit(True)
        for f, op, t in rule:
            test = test & (named[f] > t if op == ">" else named[f] <= t)
        case = F.when(test, F.lit(False)) if case is None else case.when(test, F.lit(False))
    return case.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Every row of ``docs`` with ``COUNTS``, ``base_failed`` and ``kept`` added (same-named columns replaced).

    Null, empty and very short texts fail the base rule; repeated rows are judged alike.
    Without labels only the base rule decides.
    """
    rules = fit(docs, labels, fit_rows)
    df = counts(docs.drop("base_failed", "kept"))
    return df.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & decision(rules))
