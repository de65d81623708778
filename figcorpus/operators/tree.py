"""Question trees and answer chains: paths, counts, scores, training sets.

Tables: nodes(tree, node, parent, ...) and chain logs(tree, chain, pos, type, no, ...).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figcorpus.functions import parsing as ps
from figcorpus.operators.ranking import with_position, with_running_sum
from figcorpus.session import durable

TREE = ("fq_no",)
# fixed values: limits and weights of the tree search
MAX_CHAIN_ENTRIES = 20
MAX_CHAINS = 20
FIRST_LAYER = 20
EXPLORATION = math.sqrt(2)
REUSE_SLOPE, REUSE_CENTER = 1.0, 5.0


# ---- paths -----------------------------------------------------------------------------


def leaf_nodes(nodes: DataFrame, node="question_node_no", parent="parent_node_no", tree=TREE) -> DataFrame:
    """Nodes that are nobody's parent."""
    parents = nodes.select(*tree, F.col(parent).alias(node)).distinct()
    return nodes.join(parents, [*tree, node], "left_anti")


def root_paths(
    nodes: DataFrame, node="question_node_no", parent="parent_node_no", tree=TREE, root_label: int | None = None, max_rounds: int = 12
) -> DataFrame:
    """Path from the root to every node.

    Paths double in length each round: a path is put behind the path of the node above
    its top, so depth d takes log2(d) joins instead of d. ``root_label`` is written in
    front where the root itself has no row. The node above is unique, so a parent with
    very many children is split by the skew join without repeats.
    """
    state = durable(
        nodes.select(*tree, F.col(node).alias("node"), F.array(F.col(node)).alias("path"), F.col(parent).alias("up"))
    )
    for _ in range(max_rounds):
        above = state.select(
            *[F.col(t).alias(f"_{t}") for t in tree],
            F.col("node").alias("_node"),
            F.col("path").alias("_path"),
            F.col("up").alias("_up"),
        )
        on = F.col("up") == F.col("_node")
        for t in tree:
            on = on & (F.col(t) == F.col(f"_{t}"))
        state = durable(
            state.join(above, on, "left").select(
                *tree,
                "node",
                F.when(F.col("_path").isNotNull(), F.concat("_path", "path")).otherwise(F.col("path")).alias("path"),
                F.col("_up").alias("up"),
            )
        )
        if state.where("up IS NOT NULL").isEmpty():
            break
    else:
        raise ValueError(f"paths longer than {2 ** max_rounds} nodes, or a cycle")
    path = F.col("path")
    if root_label is not None:
        path = F.concat(F.array(F.lit(root_label).cast(state.schema["path"].dataType.elementType)), path)
    return state.select(*tree, "node", path.alias("path"))


def leaf_to_root_chains(nodes: DataFrame, node="question_node_no", parent="parent_node_no", tree=TREE, root_label=None):
    """One path per leaf, from the root down."""
    leaves = leaf_nodes(nodes, node, parent, tree).select(*tree, F.col(node).alias("node"))
    return root_paths(nodes, node, parent, tree, root_label).join(leaves, [*tree, "node"], "left_semi")


def chain_text(path="path") -> Column:
    """0->3->7"""
    return F.array_join(F.col(path).cast("array<string>"), "->")


def order_by_chain(chains: DataFrame, nodes: DataFrame, node="question_node_no", tree=TREE) -> DataFrame:
    """Nodes in the order they first appear along the chains, the others behind them."""
    first = (
        chains.select(*tree, "chain_no", F.posexplode("path").alias("pos", node))
        .groupBy(*tree, node)
        .agg(F.min(F.struct("chain_no", "pos")).alias("_first"))
    )
    placed = nodes.select(*tree, node).join(first, [*tree, node], "left")
    return with_position(placed, [F.col("_first").isNull(), "_first", node], tree).drop("_first")


def prune_nodes(nodes: DataFrame, reliability: DataFrame, least: float = 0.8, node="question_node_no", parent="parent_node_no", tree=TREE):
    """Nodes without an unreliable node on their path."""
    bad = reliability.where(F.col("reliability") < least).select(*tree, F.col(node).alias("_on_path"))
    paths = root_paths(nodes, node, parent, tree)
    lost = (
        paths.select(*tree, F.col("node").alias(node), F.explode("path").alias("_on_path"))
        .join(bad, [*tree, "_on_path"], "left_semi")
        .select(*tree, node)
        .distinct()
    )
    return nodes.join(lost, [*tree, node], "left_anti")


# ---- counts ----------------------------------------------------------------------------


def backpropagate(nodes: DataFrame, log: DataFrame, node="question_node_no", tree=TREE, count_visits: bool = False):
    """One more victory for every question on a correct chain; with ``count_visits`` one
    more visit for every chain the question is on."""
    seen = (
        log.where("type = 'question'")
        .groupBy(*tree, F.col("no").alias(node))
        .agg(F.count("*").alias("_visits"), F.count_if("correct").alias("_wins"))
    )
    out = nodes.join(seen, [*tree, node], "left").withColumn(
        "victory_count", F.col("victory_count") + F.coalesce("_wins", F.lit(0))
    )
    if count_visits:
        out = out.withColumn("visit_count", F.col("visit_count") + F.coalesce("_visits", F.lit(0)))
    return out.drop("_visits", "_wins")


def chain_wins(log: DataFrame, tree=TREE) -> DataFrame:
    """Chains and correct chains through every question, answer and final answer."""
    return log.groupBy(*tree, "type", "no").agg(
        F.count("*").alias("visit_count"), F.count_if("correct").alias("victory_count")
    )


def answer_actions(log: DataFrame, tree=TREE, node="question_node_no") -> DataFrame:
    """Answers given at each node, each once with its visits, numbered as they first came."""
    seen = log.groupBy(*tree, node, "answer").agg(
        F.count("*").alias("visit_count"), F.min(F.struct("chain_no", "pos")).alias("_first")
    )
    numbered = with_position(seen, ["_first"], tree, "answer_no")
    return numbered.withColumn("answer_no", F.col("answer_no") - 1).drop("_first")


def selection_visits(log: DataFrame, tree=TREE, step="step", child="child_no") -> DataFrame:
    """Adds ``root_visits`` and ``child_visits`` of a logged search as they stand at each selection.

    ``log`` has a row per selection, in the order of ``step``: tree, ``restart``
    (the search begins again at the root), the parent and the selected child. A
    restart is a visit of the root; a selection is one of the child, counted from the next step on.
    """
    rooted = with_running_sum(log, [step], F.col("restart").cast("bigint"), tree, "root_visits")
    chosen = with_position(rooted, [step], (*tree, child), "child_visits")
    return chosen.withColumn("child_visits", F.col("child_visits") - 1)


def replay_selections(
    log: DataFrame, nodes: DataFrame, tree=TREE, node="question_node_no", parent="parent_node_no", step="step", child="child_no", c: float = EXPLORATION
) -> DataFrame:
    """What each logged selection chose, and the best child by the scores as they stood then.

    ``nodes`` holds the visits and victories before the log, ``log`` has ``won`` for
    each selection. Each selection is written out once per child of its parent, and
    a child's visits and victories then are running sums over its own rows, so the work is the
    log times the children of a node. Adds best_node, best_uct, uct (that of the chosen child) and
    ``was_best``; the lowest number wins a tie.
    """
    kids = nodes.select(*tree, parent, F.col(node).alias("_kid"), F.col("visit_count").alias("_v"), F.col("victory_count").alias("_w"))
    rows = log.select(*tree, step, parent, child, "won").join(kids, [*tree, parent])
    taken = F.col("_kid") == F.col(child)
    order, group = [step], (*tree, parent, "_kid")
    rows = rows.withColumn("_taken", taken.cast("bigint")).withColumn("_won", (taken & F.col("won")).cast("bigint"))
    both = with_running_sum(rows, order, F.col("_taken"), group, "_seen")
    both = with_running_sum(both, order, F.col("_won"), group, "_wins")
    visits = F.col("_v") + F.col("_seen") - F.col("_taken")
    wins = F.col("_w") + F.col("_wins") - F.col("_won")
    then = both.withColumns({"_n": visits, "_q": wins / visits})
    total = then.groupBy(*tree, step).agg(F.sum("_n").alias("_total"))
    scored = then.join(total, [*tree, step]).withColumn("_uct", F.col("_q") + F.lit(c) * F.sqrt(F.log(F.col("_total").cast("double")) / F.col("_n")))
    best = F.max_by(F.struct("_kid", "_uct"), F.struct(F.col("_uct"), -F.col("_kid")))
    told = scored.groupBy(*tree, step, parent, child).agg(best.alias("_b"), F.max(F.when(F.col("_kid") == F.col(child), F.col("_uct"))).alias("uct"))
    return told.select(
        *tree, step, parent, child, "uct", F.col("_b._kid").alias("best_node"), F.col("_b._uct").alias("best_uct"),
        (F.col("_b._kid") == F.col(child)).alias("was_best"),
    )


def child_counts(nodes: DataFrame, node="question_node_no", parent="parent_node_no", tree=TREE) -> DataFrame:
    """Children of every node, and whether it is a leaf."""
    kids = nodes.groupBy(*tree, F.col(parent).alias(node)).agg(F.count("*").alias("n_children"))
    return (
        nodes.join(kids, [*tree, node], "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("is_leaf", F.col("n_children") == 0)
    )


def capability_counts(log: DataFrame, keys: list[str], capability="capability") -> DataFrame:
    """Steps per capability level of each chain."""
    return log.groupBy(*keys).agg(
        *[F.count_if(F.col(capability) == c).alias(c.lower()) for c in ps.CAPABILITIES]
    )


def next_capability(log: DataFrame, keys: list[str], chains: DataFrame | None = None, pos="pos", capability="capability"):
    """Level of the next question from the chain's last level and how often it came.

    The first two levels stay up to three steps and the next three up to two; one step
    earlier a hint to move on is set. Decision support stays. Chains without steps
    (given in ``chains``) start with perception.
    """
    names = ps.CAPABILITIES
    counted = log.groupBy(*keys).agg(
        F.max_by(capability, pos).alias("_last"),
        *[F.count_if(F.col(capability) == c).alias(f"_n{i}") for i, c in enumerate(names)],
    )
    if chains is not None:
        counted = chains.select(*keys).join(counted, keys, "left")
    last = F.col("_last")
    count = F.coalesce(*[F.when(last == c, F.col(f"_n{i}")) for i, c in enumerate(names)])
    most = F.when(last.isin(*names[:2]), F.lit(3)).otherwise(F.lit(2))
    final = last == names[-1]
    follower = F.coalesce(*[F.when(last == a, F.lit(b)) for a, b in zip(names, names[1:])])
    start = F.lit(names[0])
    return counted.select(
        *keys,
        F.when(last.isNull(), start).when(final, last).when(count >= most, follower).otherwise(last).alias("current_capability"),
        F.when(last.isNull(), start).when(final, last).otherwise(follower).alias("next_capability"),
        F.when(last.isNotNull() & ~final & (count == most - 1), 1).otherwise(0).alias("hint"),
    )


def next_numbers(rows: DataFrame, keys: list[str], no: str) -> DataFrame:
    """First free number per group."""
    return rows.groupBy(*keys).agg((F.max(no) + 1).alias("next_no"))


def deficit_fill(questions: DataFrame, first_layer: DataFrame, keys: list[str], target: int = FIRST_LAYER) -> DataFrame:
    """One row per first-layer node a question still lacks."""
    have = first_layer.groupBy(*keys).agg(F.count("*").alias("_have"))
    lacking = F.greatest(F.lit(target) - F.coalesce("_have", F.lit(0)), F.lit(0))
    return (
        questions.select(*keys)
        .join(have, keys, "left")
        .withColumn("missing", lacking.cast("int"))
        .where("missing > 0")
        .select(*keys, F.explode(F.sequence(F.lit(1), F.col("missing"))).alias("slot"))
    )


# ---- scores ----------------------------------------------------------------------------


def uct_scores(nodes: DataFrame, node="question_node_no", parent="parent_node_no", tree=TREE, c: float = EXPLORATION):
    """Win rate plus c * sqrt(ln(visits of all siblings) / visits). The sum over siblings is
    an aggregate joined back, so a parent with very many children is no hot window."""
    total = nodes.groupBy(*tree, parent).agg(F.sum("visit_count").alias("_total"))
    rate = F.col("victory_count") / F.col("visit_count")
    return (
        nodes.join(total, [*tree, parent])
        .withColumn("uct", rate + F.lit(c) * F.sqrt(F.log(F.col("_total")) / F.col("visit_count")))
        .drop("_total")
    )


def ucb_scores(nodes: DataFrame, node="question_node_no", parent="parent_node_no", tree=TREE, c: float = EXPLORATION):
    """Earlier rule: the parent's own visits, and infinity for a node never visited."""
    up = nodes.select(*tree, F.col(node).alias(parent), F.greatest(F.col("visit_count"), F.lit(1)).alias("_up"))
    rate = F.col("victory_count") / F.col("visit_count")
    score = F.when(F.col("visit_count") == 0, F.lit(float("inf"))).otherwise(
        rate + F.lit(c) * F.sqrt(F.log(F.coalesce("_up", F.lit(1)).cast("double")) / F.col("visit_count"))
    )
    return nodes.join(up, [*tree, parent], "left").withColumn("uct", score).drop("_up")


def select_child(scored: DataFrame, node="question_node_no", parent="parent_node_no", tree=TREE) -> DataFrame:
    """Best child of every parent, the lowest number on a tie."""
    best = F.max_by(F.struct(F.col(node), F.col("uct")), F.struct(F.col("uct"), -F.col(node)))
    return scored.groupBy(*tree, parent).agg(best.alias("_b")).select(*tree, parent, f"_b.{node}", "_b.uct")


def reuse_probability(counts: DataFrame, slope: float = REUSE_SLOPE, center: float = REUSE_CENTER, seed: int = 0, tree=TREE, node="question_node_no"):
    """Chance to go on with an existing child, growing with their number, and a seeded draw."""
    p = 1 / (1 + F.exp(-F.lit(slope) * (F.col("n_children") - F.lit(center))))
    draw = F.pmod(F.xxhash64(*tree, node, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return counts.withColumn("reuse_probability", p).withColumn("reuse", (F.col("n_children") > 0) & (draw < p))


def node_reliability(log: DataFrame, tree=TREE, node="question_node_no", good: float = 0.8) -> DataFrame:
    """Share of a node's chains that end right, and of those that end wrong with the node
    itself answered wrong."""
    return (
        log.where("type = 'question'")
        .groupBy(*tree, F.col("no").alias(node))
        .agg(
            F.count("*").alias("n_chains"),
            F.avg(F.col("correct").cast("double")).alias("reliability"),
            F.avg((~F.col("correct") & ~F.col("node_ok")).cast("double")).alias("sensitivity"),
        )
        .withColumn("is_good", F.col("reliability") >= good)
    )


def chain_completeness(log: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the steps behind the first that follow from the step before."""
    linked = F.when(F.col("pos") > 0, F.col("linked").cast("double"))
    return log.groupBy(*keys).agg(F.coalesce(F.avg(linked), F.lit(1.0)).alias("completeness"))


# ---- bookkeeping -----------------------------------------------------------------------


def built_questions(questions: DataFrame, trees: DataFrame, image: str, no: str) -> DataFrame:
    """Per image: questions, how many have a tree, whether all do, the first that has none."""
    done = trees.select(image, no).distinct().withColumn("_built", F.lit(True))
    return (
        questions.join(done, [image, no], "left")
        .groupBy(image)
        .agg(
            F.count("*").alias("n_questions"),
            F.count("_built").alias("n_built"),
            F.min(F.when(F.col("_built").isNull(), F.col(no))).alias("next_no"),
        )
        .withColumn("all_built", F.col("n_built") == F.col("n_questions"))
    )


def init_roots(questions: DataFrame, keep: list[str]) -> DataFrame:
    """Root node of each question's tree."""
    return questions.select(
        *keep,
        F.lit(0).alias("question_node_no"),
        F.lit(-1).alias("parent_node_no"),
        F.lit(1).alias("visit_count"),
        F.lit(0).alias("victory_count"),
    )


def number_nodes(nodes: DataFrame, order: list[str], tree=TREE, out="question_node_no") -> DataFrame:
    """Node numbers from 0 in the order of insertion."""
    return with_position(nodes, order, tree, out).withColumn(out, F.col(out) - 1)


def answer_texts(answer="answer", options="options") -> Column:
    """Option texts of comma-separated letters, one per line; "None" when a letter has none."""
    letters = F.split(F.col(answer), ",")
    texts = F.transform(letters, lambda x: F.try_element_at(F.col(options), x))
    whole = F.forall(texts, lambda t: t.isNotNull())
    return F.when(F.coalesce(whole, F.lit(False)), F.concat(F.array_join(texts, "\n"), F.lit("\n"))).otherwise("None")


def chain_facts(steps: DataFrame, keys: list[str]) -> DataFrame:
    """Named facts of a chain's steps: QA_Node_<k>_Content, question and answer text."""
    return steps.select(
        *keys,
        "pos",
        F.concat(F.lit("QA_Node_"), (F.col("pos") + 1).cast("string"), F.lit("_Content")).alias("name"),
        F.coalesce("question", F.lit("None")).alias("question"),
        answer_texts().alias("answer_text"),
    )


def stop_chains(chains: DataFrame, max_entries: int = MAX_CHAIN_ENTRIES, max_chains: int = MAX_CHAINS) -> DataFrame:
    """A chain is complete at decision support once judged sufficient or full; a tree is
    complete with its last allowed chain. ``n_entries`` does not count the root."""
    full = F.col("sufficient") | (F.col("n_entries") >= max_entries)
    return chains.withColumn(
        "chain_complete", F.coalesce((F.col("last_capability") == "Decision_support") & full, F.lit(False))
    ).withColumn("tree_complete", F.col("chain_complete") & (F.col("chain_no") >= max_chains))


def any_can_answer(log: DataFrame, keys: list[str]) -> DataFrame:
    """Whether some step says that it can answer the final question."""
    return log.groupBy(*keys).agg(F.bool_or(F.coalesce("can_answer_finalq", F.lit(False))).alias("can_answer"))


def build_sft(steps: DataFrame, keys: list[str], cot: bool = True) -> DataFrame:
    """Training rows: with reasoning, every step's question and answer in order in front of
    the last answer; without, the last pair alone. A chain has at most 20 steps."""
    last = F.max_by(F.struct("question", "answer_text"), "pos").alias("_last")
    if not cot:
        return steps.groupBy(*keys).agg(last).select(
            *keys, F.col("_last.question").alias("instruction"), F.col("_last.answer_text").alias("output")
        )
    rows = F.array_sort(F.collect_list(F.struct("pos", "question", "answer_text")))
    text = F.array_join(
        F.transform(
            "_steps",
            lambda s, i: F.concat(
                F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s["question"], F.lit("\nAnswer: "), s["answer_text"]
            ),
        ),
        "\n",
    )
    return (
        steps.groupBy(*keys)
        .agg(rows.alias("_steps"), last)
        .select(
            *keys,
            F.col("_last.question").alias("instruction"),
            F.concat(text, F.lit("\nFinal answer: "), F.col("_last.answer_text")).alias("output"),
        )
    )


def dataset_card(samples: DataFrame, keys: list[str], capability="capability") -> DataFrame:
    """Samples, chains, mean chain length and the share of each capability, in percent."""
    chains = samples.groupBy(*keys).agg(
        F.count("*").alias("_len"), *[F.count_if(F.col(capability) == c).alias(f"_n{i}") for i, c in enumerate(ps.CAPABILITIES)]
    )
    return chains.agg(
        F.sum("_len").alias("n_samples"),
        F.count("*").alias("n_chains"),
        F.round(F.avg("_len"), 2).alias("mean_chain_length"),
        *[
            F.round(100.0 * F.sum(f"_n{i}") / F.sum("_len"), 2).alias(f"pct_{c.lower()}")
            for i, c in enumerate(ps.CAPABILITIES)
        ],
    )
