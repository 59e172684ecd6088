"""Mixing sources to target shares of tokens.

Target shares are the weights of sources. They are propagated through a tree domain - language - source, where a source's
weight is spread over languages as its tokens are. Budgets run down the tree; what a leaf cannot give (its tokens times its
cap of repeats) goes to its siblings, then to those of its ancestors. Each leaf takes whole epochs of its texts and the prefix
of one more, in an order seeded by the epoch. What is left of the leaves' budgets because texts stay whole is added up per source and
filled with further texts of its leaves, by their lengths, so that a source misses its budget by less than one short text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.tokens import VOCABULARY, with_token_counts
from corvane.operators.order import any_rank, parts_for, prefix_sum
from corvane.session import cut

#: Domains of sources by default; others are domains of their own.
DOMAINS = {"readme": "docs", "api_doc": "docs", "design_note": "docs", "tutorial": "docs", "changelog": "history", "commit_message": "history", "review_comment": "talk", "issue_thread": "talk", "forum_post": "talk", "incident_report": "talk"}


def clean_source(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def clean_lang(c: Column) -> Column:
    """Two letters in lower case, else und: at most 677 values."""
    l = F.lower(F.trim(c))
    return F.when(l.rlike("^[a-z]{2}$"), l).otherwise("und")


@dataclass
class Node:
    name: str
    weight: float = 0.0
    capacity: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)
    budget: float = 0.0


def build_tree(leaves: list[tuple[tuple[str, ...], float, float]]) -> Node:
    """leaves: (path, weight, capacity)."""
    root = Node("")
    for path, w, cap in leaves:
        n = root
        n.weight, n.capacity = n.weight + w, n.capacity + cap
        for p in path:
            n = n.children.setdefault(p, Node(p))
            n.weight, n.capacity = n.weight + w, n.capacity + cap
    return root


def allocate(node: Node, budget: float) -> None:
    """Budgets of node and its descendants. Each child gets its weight's share, no more than its capacity; what is short goes to its siblings by weight."""
    node.budget = min(budget, node.capacity)
    left, open_ = node.budget, [c for _, c in sorted(node.children.items()) if c.capacity > 0]
    give = {c.name: 0.0 for c in open_}
    while open_ and left > 1e-9:
        w = sum(c.weight for c in open_)
        part = {c.name: left * (c.weight / w if w > 0 else 1 / len(open_)) for c in open_}
        full = [c for c in open_ if give[c.name] + part[c.name] >= c.capacity - 1e-9]
        if not full:
            for c in open_:
                give[c.name] += part[c.name]
            break
        for c in full:
            left -= c.capacity - give[c.name]
            give[c.name] = c.capacity
        open_ = [c for c in open_ if c not in full]
    for name, b in give.items():
        allocate(node.children[name], b)


def plan(tokens: dict[tuple[str, str], int], targets: dict[str, tuple[float, int]], total: float | None = None, domains: dict[str, str] = DOMAINS) -> dict[tuple[str, str], tuple[float, int]]:
    """{(source, lang): (budget, cap)}. tokens: {(source, lang): tokens}; targets: {source: (share, cap)}.

    total is by default the largest at which each source that has tokens reaches its share. Sources without tokens cannot; their
    share goes to sources of their domain, else to all. Shares are taken relative to their sum.
    """
    by_source: dict[str, int] = {}
    for (s, _), n in tokens.items():
        by_source[s] = by_source.get(s, 0) + n
    whole = sum(max(0.0, w) for w, _ in targets.values()) or 1.0
    share = {s: max(0.0, w) / whole for s, (w, _) in targets.items()}
    if total is None:
        total = min((targets[s][1] * by_source[s] / share[s] for s in targets if by_source.get(s, 0) > 0 and share[s] > 0 and targets[s][1] > 0), default=0.0)
    leaves = []
    for s, (_, cap) in sorted(targets.items()):
        langs = {l: n for (x, l), n in tokens.items() if x == s and n > 0} or {"und": 0}
        for l, n in sorted(langs.items()):
            leaves.append(((domains.get(s, s), l, s), share[s] * (n / by_source[s] if by_source.get(s) else 1.0), float(max(0, cap) * n)))
    root = build_tree(leaves)
    allocate(root, total)
    return {(s, l): (root.children[d].children[l].children[s].budget, targets[s][1]) for (d, l, s), _, _ in leaves}


def fill(rest: dict[str, int], sizes: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(source, size, how many to take): long texts first, as many as fit into what is left of each source. sizes: (source, size, how many there are)."""
    out, left = [], dict(rest)
    for s, n, c in sorted(sizes, key=lambda x: (x[0], -x[1])):
        take = min(c, left.get(s, 0) // n)
        if take > 0:
            left[s] -= take * n
            out.append((s, n, take))
    return out


def mix_with_plan(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 11, vocabulary: str = VOCABULARY, domains: dict[str, str] = DOMAINS) -> tuple[DataFrame, dict[str, float]]:
    """The rows of mix, and the budget of each source in tokens after shortages were passed on."""
    spark = documents.sparkSession
    t = targets.where(F.col("source").isNotNull()).groupBy(clean_source(F.col("source")).alias("source")).agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("w"), F.max(F.coalesce("repeat_cap", F.lit(0))).alias("cap"))
    goals = {r["source"]: (float(r["w"]), int(r["cap"])) for r in t.collect()}
    d = documents.select("doc_id", "text", clean_source(F.col("source")).alias("source"), clean_lang(F.col("lang")).alias("lang")).where(F.col("source").isin(list(goals)))
    sized = cut(with_token_counts(d, "text", ["doc_id", "source", "lang"], vocabulary=vocabulary).where("n_tokens > 0"))
    have = {(r[0], r[1]): int(r[2]) for r in sized.groupBy("source", "lang").agg(F.sum("n_tokens")).collect()}
    rows, budgets, epochs = [], dict.fromkeys(goals, 0.0), {}
    for (s, l), (b, cap) in plan(have, goals, total, domains).items():
        n = have.get((s, l), 0)
        budgets[s] += b
        if n and cap > 0:
            e = epochs[(s, l)] = min(cap, int((b + 1e-6) // n))
            rows.append((s, l, e, float(b - e * n) if e < cap else 0.0, e < cap))
    leaf = spark.createDataFrame(rows, "source string, lang string, epochs int, rest double, more boolean")
    j = sized.join(F.broadcast(leaf), ["source", "lang"])  # at most 677 rows for each target
    key = lambda epoch: F.pmod(F.xxhash64("doc_id", F.lit(seed), epoch), F.lit(1 << 40))
    cols = ["doc_id", "source", "lang", "epoch", "order_key", "n_tokens"]
    full = j.where("epochs > 0").select("doc_id", "source", "lang", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"), "n_tokens").withColumn("order_key", key(F.col("epoch"))).select(cols)
    buckets = parts_for(sized)
    last = j.where("more").withColumn("epoch", F.col("epochs")).withColumn("order_key", key(F.col("epochs")))
    last = cut(prefix_sum(last, ["source", "lang"], F.col("order_key") / F.lit(float(1 << 40)), ["doc_id"], "n_tokens", "before", buckets).withColumn("in", F.col("before") + F.col("n_tokens") <= F.col("rest")))
    part = last.where(F.col("in"))
    used = {r[0]: int(r[1]) for r in part.groupBy("source").agg(F.sum("n_tokens")).collect()}
    rest = {s: int(budgets[s] + 0.5 - used.get(s, 0) - sum(e * have[k] for k, e in epochs.items() if k[0] == s)) for s in goals}
    room = spark.createDataFrame([(s, r) for s, r in sorted(rest.items()) if r > 0], "source string, room long")
    spare = last.where(~F.col("in")).join(F.broadcast(room), "source").where("n_tokens <= room")
    # a row for each source and length below what is left of it, which is less than a text for each language
    picks = fill(rest, [(r[0], int(r[1]), int(r[2])) for r in spare.groupBy("source", "n_tokens").agg(F.count(F.lit(1))).collect()])
    ranked = any_rank(spare.join(F.broadcast(spark.createDataFrame(picks, "source string, n_tokens long, take long")), ["source", "n_tokens"]), ["source", "n_tokens"], ["order_key", "doc_id"], "rank", buckets)
    return full.unionByName(part.select(cols)).unionByName(ranked.where("rank < take").select(cols)), budgets


def mix(documents: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 11, vocabulary: str = VOCABULARY, domains: dict[str, str] = DOMAINS) -> DataFrame:
    """(doc_id, source, lang, epoch, order_key, n_tokens): a row for each use of a text; a text is used at most repeat_cap times.

    The rows are meant to be read in order of epoch and order_key. Of the last epoch a leaf takes texts up to its budget, and a source further
    texts for what its leaves have left over. Texts without tokens, and sources that have no target, are left out. A target that comes
    twice counts once, with its largest share; a null share or cap counts as 0. Repeated rows of a document are texts of their own.
    domains: the domain of each source; a source that is not named is a domain of its own.
    """
    return mix_with_plan(documents, targets, total, seed, vocabulary, domains)[0]


def share_report(mixed: DataFrame, targets: DataFrame, budgets: dict[str, float] | None = None) -> DataFrame:
    """Per source of targets: target, planned (after shortages were passed on) and reached share, what is lacking to the target's share, tokens, rows, distinct texts, most uses of one text."""
    spark = mixed.sparkSession
    per = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("uses"))
    per = per.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("uses").alias("n_rows"), F.count(F.lit(1)).alias("n_docs"), F.max("uses").alias("most_uses"))
    t = targets.where(F.col("source").isNotNull()).groupBy(clean_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("repeat_cap").alias("repeat_cap"))
    whole = sum((budgets or {}).values()) or 1.0
    p = spark.createDataFrame([(s, b / whole) for s, b in sorted((budgets or {}).items())], "source string, planned double")
    j = t.join(per, "source", "left").join(F.broadcast(p), "source", "left").withColumn("whole", F.sum("n_tokens").over(Window.partitionBy()))  # a row for each target
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    share = F.coalesce(F.col("n_tokens") / F.col("whole"), F.lit(0.0))
    return j.select("source", "target_share", "repeat_cap", F.round("planned", 6).alias("planned_share"), F.round(share, 6).alias("share"), F.round(F.greatest(F.lit(0.0), F.col("target_share") - share), 6).alias("lacking"), z("n_tokens"), z("n_rows"), z("n_docs"), z("most_uses"))


def with_texts(mixed: DataFrame, documents: DataFrame) -> DataFrame:
    """The mixed rows with their texts, for writing: doc_id must be unique in documents."""
    return mixed.join(documents.select("doc_id", "text"), "doc_id")
