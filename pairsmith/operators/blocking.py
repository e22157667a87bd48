"""The rule-driven blocker (J8, J9), its evaluation (A3-A9) and rankings of candidates."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsmith.functions import similarity, tokens
from pairsmith.operators import joins
from pairsmith.plans.rules import Rule, simplify

PAIR = ["ltable_id", "rtable_id"]


def join_rule(rule: Rule, a: DataFrame, b: DataFrame | None, key: str = "_id") -> DataFrame:
    f = rule.feature
    if f.sim in ("jac", "cos", "dice", "overlap"):
        tok = tokens.tokenizer(f.tok, f.setting)
        return joins.set_join(a, b, f.sim, rule.threshold, tok(F.col(f.lattr)), tok(F.col(f.rattr)), key, key)
    if f.sim == "lev":
        return joins.edit_join(a, b, rule.threshold, f.lattr, f.rattr, key, key)
    if f.sim == "exm":
        return joins.exact_join(a, b, f.lattr, f.rattr, key, key)
    return joins.numeric_join(a, b, rule.threshold, f.lattr, f.rattr, key, key)


def _jaccard(rule: Rule) -> float:
    """The jaccard that a dice rule's pairs have at least, or the rule's own."""
    t = rule.threshold
    return t / (2 - t) if rule.feature.sim == "dice" else t


def _nested(rules: list[Rule]) -> list[list[Rule]]:
    """Rules by what answers them: jaccard and dice of the same tokens, loosest first, since that finds all pairs of the others."""
    out: dict[tuple, list[Rule]] = {}
    for i, r in enumerate(rules):
        f = r.feature
        out.setdefault((f.lattr, f.rattr, f.tok, f.setting) if f.sim in ("jac", "dice") else (i,), []).append(r)
    return [sorted(group, key=_jaccard) if len(group) > 1 else group for group in out.values()]


def _parts(group: list[Rule], a: DataFrame, b: DataFrame | None, key: str, known: dict[Rule, DataFrame]) -> list[DataFrame]:
    """The pairs of each rule of a group, with their number of rules as rows of one table where one join finds them all."""
    found = known[group[0]] if group[0] in known else join_rule(group[0], a, b, key)
    if len(group) == 1:
        return [found]
    holds = [F.col("overlap") >= joins.least_overlap(r.feature.sim, r.threshold, F.col("size_l"), F.col("size_r")) for r in group]
    return [found.withColumn("n", functools.reduce(Column.__add__, (h.cast("long") for h in holds)))]


def merge(parts: list[DataFrame]) -> DataFrame:
    """A3: the union of rule results, with n_rules, the number of rules that found a pair."""
    union = functools.reduce(DataFrame.unionByName, (p.select(*PAIR, F.col("n") if "n" in p.columns else F.lit(1).cast("long").alias("n")) for p in parts))
    return union.groupBy(*PAIR).agg(F.sum("n").alias("n_rules"))


def block(rules: list[Rule], a: DataFrame, b: DataFrame | None = None, key: str = "_id", max_pairs: int | None = None, rank_attr: str | None = None, known: dict[Rule, DataFrame] | None = None) -> DataFrame:
    """Candidates (ltable_id, rtable_id, n_rules) that any rule finds; b None is a self join. With max_pairs the
    best by K1 on rank_attr are kept (K6). known: what join_rule gives for rules of which that is at hand."""
    out = merge([part for group in _nested(simplify(rules)) for part in _parts(group, a, b, key, known or {})])
    if max_pairs is not None:
        rows = attach(out, a, b, [rank_attr], key)
        best = top_k(rows, max_pairs, f"ltable_{rank_attr}", f"rtable_{rank_attr}")
        out = out.join(best.select(*PAIR), PAIR, "left_semi")
    return out


def attach(pairs: DataFrame, a: DataFrame, b: DataFrame | None, attrs: list[str], key: str = "_id") -> DataFrame:
    """The attributes of both rows, prefixed ltable_ and rtable_."""
    right = a if b is None else b
    l = a.select(F.col(key).alias("ltable_id"), *(F.col(x).alias(f"ltable_{x}") for x in attrs))
    r = right.select(F.col(key).alias("rtable_id"), *(F.col(x).alias(f"rtable_{x}") for x in attrs))
    return pairs.join(l, "ltable_id").join(r, "rtable_id")


def recall(candidates: DataFrame, gold: DataFrame, rows_a: DataFrame, rows_b: DataFrame | None = None) -> DataFrame:
    """A4: one row of n_candidates, n_gold, n_hits, recall and cssr (candidates among all pairs)."""
    hits = joins.members(candidates, gold).agg(F.count("*").alias("n_hits"))
    out = candidates.agg(F.count("*").alias("n_candidates")).join(gold.agg(F.count("*").alias("n_gold"))).join(hits)
    n = rows_a.agg(F.count("*").cast("double").alias("na"))
    whole = n.select((F.col("na") * (F.col("na") - 1) / 2).alias("whole")) if rows_b is None else n.join(rows_b.agg(F.count("*").cast("double").alias("nb"))).select((F.col("na") * F.col("nb")).alias("whole"))
    return out.join(whole).select("n_candidates", "n_gold", "n_hits", F.try_divide(F.col("n_hits").cast("double"), F.col("n_gold")).alias("recall"), F.try_divide(F.col("n_candidates").cast("double"), F.col("whole")).alias("cssr"))


def labelled(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """P5: label 1 for pairs in gold, else 0."""
    g = gold.select(F.col("id1").alias("ltable_id"), F.col("id2").alias("rtable_id"), F.lit(1).alias("_g")).distinct()
    return pairs.join(g, PAIR, "left").withColumn("label", F.coalesce("_g", F.lit(0))).drop("_g")


def recall_by_rules(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """A5: pairs and gold hits by n_rules."""
    return labelled(candidates, gold).groupBy("n_rules").agg(F.count("*").alias("n_pairs"), F.sum("label").cast("long").alias("n_hits"))


def recall_curve(ranked: DataFrame, gold: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Gold hits among the best k*m/50 pairs for m in 1, 3, 5, 8, 10, 20, 50. Ranks come from TakeOrdered, not from a
    window over everything."""
    best = labelled(ranked.orderBy(F.desc(score), *PAIR).limit(k), gold)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *PAIR)))  # at most k rows
    sums = [F.sum(F.when(F.col("rank") <= k * m // 50, F.col("label")).otherwise(0)).cast("long").alias(f"hits_{m}") for m in (1, 3, 5, 8, 10, 20, 50)]
    return best.agg(*sums)


def _harmonic(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def rule_value(rule: Rule, left: str = "ltable_", right: str = "rtable_") -> Column:
    f = rule.feature
    a, b = F.col(left + f.lattr), F.col(right + f.rattr)
    if f.tok:
        t = tokens.tokenizer(f.tok, f.setting)
        return similarity.feature(f.sim, t(a), t(b))
    return similarity.REGISTRY[f.sim](a, b)


def rule_utility(sample: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rule, precision = hits / (predicted + missing), recall = hits / positives and f1 over a labelled pair table."""
    sums = [F.sum("label").cast("double").alias("pos")]
    for i, r in enumerate(rules):
        v = rule_value(r)
        hit = F.coalesce(v >= r.threshold if r.sign == "+" else v <= r.threshold, F.lit(False))
        sums += [F.sum(hit.cast("int")).alias(f"p{i}"), F.sum((hit & (F.col("label") == 1)).cast("int")).alias(f"h{i}"), F.sum(v.isNull().cast("int")).alias(f"m{i}")]
    one = sample.agg(*sums)
    rows = F.explode(F.array(*(F.struct(F.lit(r.feature.name).alias("rule"), F.lit(r.feature.lattr).alias("attr"), F.try_divide(F.col(f"h{i}").cast("double"), F.col(f"p{i}") + F.col(f"m{i}")).alias("p"), F.try_divide(F.col(f"h{i}").cast("double"), F.col("pos")).alias("r")) for i, r in enumerate(rules)))).alias("x")
    return one.select(rows).select("x.rule", "x.attr", F.coalesce("x.p", F.lit(0.0)).alias("precision"), F.coalesce("x.r", F.lit(0.0)).alias("recall")).withColumn("f1", _harmonic(F.col("precision"), F.col("recall")))


def attribute_utility(utility: DataFrame) -> DataFrame:
    """A8."""
    return utility.groupBy("attr").agg(F.avg("f1").alias("f1"))


def quality(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """n_predicted, n_gold, n_hits, precision, recall and f1 of predicted pairs."""
    counts = recall(predicted, gold, predicted)
    p = F.coalesce(F.try_divide(F.col("n_hits").cast("double"), F.col("n_candidates")), F.lit(0.0))
    return counts.select(F.col("n_candidates").alias("n_predicted"), "n_gold", "n_hits", p.alias("precision"), F.coalesce("recall", F.lit(0.0)).alias("recall")).withColumn("f1", _harmonic(F.col("precision"), F.col("recall")))


def compare(first: DataFrame, second: DataFrame, gold: DataFrame) -> DataFrame:
    """Pairs in both results, in one of them only, and gold hits of each part."""
    both = first.select(*PAIR).distinct().withColumn("f", F.lit(1)).join(second.select(*PAIR).distinct().withColumn("s", F.lit(1)), PAIR, "full")
    part = F.when(F.col("f").isNull(), "second").when(F.col("s").isNull(), "first").otherwise("both")
    return labelled(both.select(*PAIR, part.alias("part")), gold).groupBy("part").agg(F.count("*").alias("n_pairs"), F.sum("label").cast("long").alias("n_hits"))


def ta_score(a: Column, b: Column) -> Column:
    """K1: jaccard + cosine + dice + overlap coefficient of two token sets; null if a side is empty."""
    return functools.reduce(Column.__add__, (similarity.feature(n, a, b) for n in ("jac", "cos", "dice", "coeff")))


def top_k(rows: DataFrame, k: int, left: str, right: str) -> DataFrame:
    """K1: the k pairs of a pair table with the highest score, ties to smaller ids; pairs with an empty side are left out
    unless there are no more than k pairs in all (then every pair stays, unscored ones last)."""
    scored = rows.withColumn("score", ta_score(tokens.dlm(F.col(left)), tokens.dlm(F.col(right))))
    small = rows.limit(k + 1).agg((F.count("*") <= k).alias("_all"))
    return scored.join(F.broadcast(small)).where("score is not null or _all").drop("_all").orderBy(F.desc_nulls_last("score"), *PAIR).limit(k).select(*PAIR, "score")


def best(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k pairs with the highest score, ties to smaller ids."""
    return scored.where(F.col(score).isNotNull()).orderBy(F.desc(score), *PAIR).limit(k)


def weighted_sums(rows: DataFrame, left: str, right: str, weights: DataFrame) -> DataFrame:
    """A2, M6: pairs with o, x and y: the sums of weights (tok, w) of shared tokens (the weighted overlap) and of both sides."""
    side = lambda c: rows.select(*PAIR, F.explode(tokens.dlm(F.col(c))).alias("tok"))
    both = side(left).withColumn("l", F.lit(1)).join(side(right).withColumn("r", F.lit(1)), [*PAIR, "tok"], "full").join(weights.select("tok", "w"), "tok")
    return both.groupBy(*PAIR).agg(*(F.sum(F.when(c, F.col("w")).otherwise(0.0)).alias(n) for n, c in (("o", F.col("l").isNotNull() & F.col("r").isNotNull()), ("x", F.col("l").isNotNull()), ("y", F.col("r").isNotNull()))))


def weighted_scores(rows: DataFrame, left: str, right: str, weights: DataFrame) -> DataFrame:
    """K2: pairs with the sum of the four idf-weighted measures; weights: (tok, w)."""
    sums = weighted_sums(rows, left, right, weights)
    score = functools.reduce(Column.__add__, (similarity.weighted(n, F.col("o"), F.col("x"), F.col("y")) for n in ("jac", "cos", "dice", "coeff")))
    return sums.withColumn("score", score).select(*PAIR, "score")


def rule_scores(rows: DataFrame, rules: list[Rule], weights: list[float]) -> DataFrame:
    """K3: the weighted sum of all rules' similarities (overlap as coefficient, edit distance as similarity; missing: 0)."""
    total = sum(weights) or 1.0
    parts = []
    for r, w in zip(rules, weights, strict=True):
        f = r.feature
        a, b = F.col(f"ltable_{f.lattr}"), F.col(f"rtable_{f.rattr}")
        if f.sim == "overlap":
            t = tokens.tokenizer(f.tok, f.setting)
            v = similarity.feature("coeff", t(a), t(b))
        elif f.sim == "lev":
            v = similarity.levenshtein_similarity(a, b)
        else:
            v = rule_value(r)
        parts.append(F.coalesce(v, F.lit(0.0)) * (w / total))
    return rows.withColumn("score", functools.reduce(Column.__add__, parts))


def by_attribute(rows: DataFrame, scores: dict[str, Column], k: int) -> DataFrame:
    """K4: the k pairs by per-attribute scores in the order given, each in steps of 0.01, then ids."""
    keyed = rows.withColumns({f"_s{i}": F.floor(c * 100) for i, c in enumerate(scores.values())})
    return keyed.orderBy(*(F.desc(f"_s{i}") for i in range(len(scores))), *PAIR).limit(k).select(*PAIR)


def top_k_features(table: DataFrame, features: list[str], k: int) -> DataFrame:
    """K7: the k rows with the largest sum of feature columns."""
    total = functools.reduce(Column.__add__, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features))
    return table.withColumn("score", total).orderBy(F.desc("score"), *PAIR).limit(k)


def multiset_jaccard(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs with the jaccard of their token multisets."""
    side = lambda c, n: rows.select(*PAIR, F.explode(tokens.pieces(F.col(c))).alias("tok")).groupBy(*PAIR, "tok").agg(F.count("*").alias(n))
    both = side(left, "x").join(side(right, "y"), [*PAIR, "tok"], "full").na.fill(0, ["x", "y"])
    return both.groupBy(*PAIR).agg(F.sum(F.least("x", "y")).alias("o"), F.sum(F.greatest("x", "y")).alias("u")).select(*PAIR, (F.col("o").cast("double") / F.col("u")).alias("score"))
