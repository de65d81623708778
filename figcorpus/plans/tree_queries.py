"""Queries over question trees and chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from figcorpus.functions import parsing as ps
from figcorpus.operators import tree as tr
from figcorpus.plans import fixtures as fx
from figcorpus.plans.registry import query, table

T = f"""tree AS ({fx.TREE_SQL}),
paths AS (SELECT fq_no, question_node_no node, [question_node_no] path, 0 depth FROM tree WHERE parent_node_no=-1
  UNION ALL SELECT t.fq_no, t.question_node_no, list_append(p.path, t.question_node_no), p.depth+1 FROM tree t
  JOIN paths p ON p.fq_no=t.fq_no AND p.node=t.parent_node_no),
leaves AS (SELECT p.* FROM paths p WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.fq_no=p.fq_no AND t.parent_node_no=p.node)),
chains AS (SELECT *, row_number() OVER (PARTITION BY fq_no ORDER BY node) chain_no, (fq_no+node)%3<>0 correct FROM leaves),
log AS (SELECT c.fq_no, c.chain_no, c.correct, k-1 pos, c.path[k] AS "no",
   ['Perception','Data_extraction','Calculation_analysis','Pattern_recognition','Logical_reasoning','Decision_support'][least(k,6)] capability,
   (c.path[k]+c.fq_no)%4<>0 node_ok, (c.path[k]+k)%5<>0 linked, CASE WHEN (c.path[k]+c.chain_no)%2=0 THEN 'A' ELSE 'A,C' END answer,
   (c.path[k]*c.chain_no)%11=5 can_answer_finalq
  FROM chains c, (SELECT unnest(range(1,30)) k) WHERE k<=len(c.path))"""
R = f"WITH RECURSIVE {T}"


def _nodes(spark, sf):
    return fx.tree(spark, sf)


def _chains(spark, sf):
    from figcorpus.operators.ranking import with_position

    leaves = tr.leaf_to_root_chains(_nodes(spark, sf))
    return with_position(leaves, ["node"], ("fq_no",), "chain_no").withColumn(
        "correct", F.expr("(fq_no + node) % 3 <> 0")
    )


def _log(spark, sf):
    names = F.array(*[F.lit(c) for c in ps.CAPABILITIES])
    rows = _chains(spark, sf).select("fq_no", "chain_no", "correct", F.posexplode("path").alias("pos", "no"))
    return (
        rows.withColumn("type", F.lit("question"))
        .withColumn("capability", F.get(names, F.least(F.col("pos"), F.lit(5))))
        .withColumn("node_ok", F.expr("(no + fq_no) % 4 <> 0"))
        .withColumn("linked", F.expr("(no + pos + 1) % 5 <> 0"))
        .withColumn("answer", F.expr("CASE WHEN (no + chain_no) % 2 = 0 THEN 'A' ELSE 'A,C' END"))
        .withColumn("can_answer_finalq", F.expr("(no * chain_no) % 11 = 5"))
    )


@query("h01_leaf_to_root_chains", f"{R} SELECT fq_no::BIGINT fq_no, node::BIGINT node, array_to_string(path,'->') chain FROM leaves")
def h01(spark, sf):
    return tr.leaf_to_root_chains(_nodes(spark, sf)).select("fq_no", "node", tr.chain_text().alias("chain"))


@query("a09_write_chains", f"{R} SELECT '0->'||array_to_string(list_transform(path, lambda n: n+1),'->') AS \"value\" FROM leaves")
def a09(spark, sf):
    """Chain lines of the earlier tree format, where the root 0 has no row of its own."""
    nodes = _nodes(spark, sf).select(
        "fq_no", (F.col("question_node_no") + 1).alias("node"), (F.col("parent_node_no") + 1).alias("parent")
    )
    chains = tr.leaf_to_root_chains(nodes, "node", "parent", root_label=0)
    return chains.select(tr.chain_text().alias("value"))


@query("g01_leaf_nodes", f"{R} SELECT fq_no::BIGINT fq_no, node::BIGINT question_node_no FROM leaves")
def g01(spark, sf):
    return tr.leaf_nodes(_nodes(spark, sf)).select("fq_no", "question_node_no")


@query(
    "f07_order_by_chain",
    f"""{R}, f AS (SELECT fq_no, "no", min(chain_no*1000+pos) k FROM log GROUP BY ALL)
    SELECT t.fq_no::BIGINT fq_no, t.question_node_no::BIGINT question_node_no, row_number() OVER (PARTITION BY t.fq_no ORDER BY f.k IS NULL, f.k, t.question_node_no) AS "position"
    FROM tree t LEFT JOIN f ON f.fq_no=t.fq_no AND f."no"=t.question_node_no""",
)
def f07(spark, sf):
    return tr.order_by_chain(_chains(spark, sf), _nodes(spark, sf))


@query(
    "g04_ordered_union_missing",
    f"""{R}, c2 AS (SELECT * FROM chains WHERE correct), f AS (SELECT l.fq_no, l."no", min(l.chain_no*1000+l.pos) k FROM log l WHERE l.correct GROUP BY ALL)
    SELECT t.fq_no::BIGINT fq_no, t.question_node_no::BIGINT question_node_no, row_number() OVER (PARTITION BY t.fq_no ORDER BY f.k IS NULL, f.k, t.question_node_no) AS "position"
    FROM tree t LEFT JOIN f ON f.fq_no=t.fq_no AND f."no"=t.question_node_no""",
)
def g04(spark, sf):
    """Only the correct chains were kept, so some nodes are on none of them."""
    return tr.order_by_chain(_chains(spark, sf).where("correct"), _nodes(spark, sf))


@query(
    "d11_backprop",
    f"""{R}, w AS (SELECT fq_no, "no", count(*) v, count(*) FILTER (correct) n FROM log GROUP BY ALL)
    SELECT t.fq_no::BIGINT fq_no, t.question_node_no::BIGINT question_node_no, (t.visit_count+coalesce(w.v,0))::BIGINT visit_count,
      (t.victory_count+coalesce(w.n,0))::BIGINT victory_count FROM tree t LEFT JOIN w ON w.fq_no=t.fq_no AND w."no"=t.question_node_no""",
)
def d11(spark, sf):
    out = tr.backpropagate(_nodes(spark, sf), _log(spark, sf), count_visits=True)
    return out.select("fq_no", "question_node_no", "visit_count", "victory_count")


@query(
    "d11_chain_wins",
    f"""{R}, e AS (SELECT fq_no, 'question' AS "type", "no", correct FROM log
      UNION ALL SELECT fq_no, 'answer', "no"*2+CASE WHEN answer='A' THEN 1 ELSE 0 END, correct FROM log
      UNION ALL SELECT fq_no, 'final_answer', node%4, correct FROM chains)
    SELECT fq_no::BIGINT fq_no, "type", "no"::BIGINT AS "no", count(*) visit_count, count(*) FILTER (correct) victory_count FROM e GROUP BY ALL""",
)
def d11_wins(spark, sf):
    """Visits and victories of questions, of the answers given to them and of final answers."""
    log = _log(spark, sf).select("fq_no", "type", F.col("no").cast("bigint").alias("no"), "correct", "answer")
    given = log.withColumns({"type": F.lit("answer"), "no": F.col("no") * 2 + (F.col("answer") == "A").cast("bigint")})
    final = _chains(spark, sf).select("fq_no", F.lit("final_answer").alias("type"), F.expr("node % 4").cast("bigint").alias("no"), "correct")
    return tr.chain_wins(log.unionByName(given).drop("answer").unionByName(final), ("fq_no",))


@query(
    "d12_visit_counts",
    f"""{R}, s AS (SELECT fq_no, "no" question_node_no, answer, count(*) visit_count, min(chain_no*1000+pos) f FROM log GROUP BY ALL)
    SELECT fq_no::BIGINT fq_no, question_node_no::BIGINT question_node_no, answer, visit_count, row_number() OVER (PARTITION BY fq_no ORDER BY f)-1 answer_no FROM s""",
)
def d12(spark, sf):
    return tr.answer_actions(_log(spark, sf).withColumnRenamed("no", "question_node_no"))


# Every chain is one run of a search from the root; each step down it selects a child.
SELECTED = """sel AS (SELECT l.fq_no, l.chain_no*1000+l.pos step, l.pos=1 AS "restart", t.parent_node_no, l."no" child_no, l.correct won
  FROM log l JOIN tree t ON t.fq_no=l.fq_no AND t.question_node_no=l."no" WHERE l.pos>0)"""


def _selections(spark, sf):
    chains = _chains(spark, sf).select("fq_no", "chain_no", "correct", "path", F.posexplode("path").alias("pos", "child_no"))
    return chains.where("pos > 0").select(
        "fq_no", (F.col("chain_no") * 1000 + F.col("pos")).alias("step"), (F.col("pos") == 1).alias("restart"),
        F.get("path", F.col("pos") - 1).alias("parent_node_no"), "child_no", F.col("correct").alias("won"),
    )


@query(
    "d12_selection_visits",
    f"""{R}, {SELECTED} SELECT fq_no::BIGINT fq_no, step::BIGINT step, parent_node_no::BIGINT parent_node_no, child_no::BIGINT child_no,
      count(*) FILTER ("restart") OVER (PARTITION BY fq_no ORDER BY step) root_visits, row_number() OVER (PARTITION BY fq_no, child_no ORDER BY step)-1 child_visits FROM sel""",
)
def d12_selections(spark, sf):
    return tr.selection_visits(_selections(spark, sf), ("fq_no",)).select(
        "fq_no", "step", "parent_node_no", "child_no", "root_visits", "child_visits"
    )


@query(
    "e12_replayed_choices",
    f"""{R}, {SELECTED},
    kid AS (SELECT s.*, t.question_node_no node, t.visit_count + coalesce(sum((t.question_node_no=s.child_no)::INT) OVER w, 0) n,
        t.victory_count + coalesce(sum((t.question_node_no=s.child_no AND s.won)::INT) OVER w, 0) q
      FROM sel s JOIN tree t ON t.fq_no=s.fq_no AND t.parent_node_no=s.parent_node_no
      WINDOW w AS (PARTITION BY s.fq_no, s.parent_node_no, t.question_node_no ORDER BY s.step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    sc AS (SELECT *, q/n::DOUBLE+sqrt(2.0::DOUBLE)*sqrt(ln((sum(n) OVER (PARTITION BY fq_no, step))::DOUBLE)/n) score FROM kid),
    r AS (SELECT *, row_number() OVER (PARTITION BY fq_no, step ORDER BY score DESC, node) k FROM sc)
    SELECT a.fq_no::BIGINT fq_no, a.step::BIGINT step, a.child_no::BIGINT child_no, a.node::BIGINT best_node, round(a.score,6) best_uct, round(b.score,6) uct, a.node=a.child_no was_best
    FROM r a JOIN r b ON a.fq_no=b.fq_no AND a.step=b.step AND b.node=b.child_no WHERE a.k=1""",
)
def e12_replay(spark, sf):
    out = tr.replay_selections(_selections(spark, sf), _nodes(spark, sf), ("fq_no",))
    return out.select("fq_no", "step", "child_no", "best_node", F.round("best_uct", 6).alias("best_uct"), F.round("uct", 6).alias("uct"), "was_best")


@query(
    "d13_child_counts",
    f"""{R} SELECT t.fq_no::BIGINT fq_no, t.question_node_no::BIGINT question_node_no, count(c.question_node_no) n_children, count(c.question_node_no)=0 is_leaf
    FROM tree t LEFT JOIN tree c ON c.fq_no=t.fq_no AND c.parent_node_no=t.question_node_no GROUP BY ALL""",
)
def d13(spark, sf):
    return tr.child_counts(_nodes(spark, sf)).select("fq_no", "question_node_no", "n_children", "is_leaf")


@query(
    "d14_capability_counts",
    f"{R} SELECT fq_no::BIGINT fq_no, chain_no, "
    + ", ".join(f"count(*) FILTER (capability='{c}') {c.lower()}" for c in ps.CAPABILITIES)
    + " FROM log GROUP BY ALL",
)
def d14(spark, sf):
    return tr.capability_counts(_log(spark, sf), ["fq_no", "chain_no"])


# Chains with repeated levels: two steps share a level.
NEXT_LOG = """steps AS (SELECT fq_no, chain_no, pos, ['Perception','Data_extraction','Calculation_analysis','Pattern_recognition','Logical_reasoning','Decision_support'][least(pos//2+1+fq_no%4,6)] cap FROM log)"""


@query(
    "e11_next_capability",
    f"""{R}, {NEXT_LOG}, l AS (SELECT fq_no, chain_no, arg_max(cap, pos) last FROM steps GROUP BY ALL),
    n AS (SELECT l.*, count(*) FILTER (s.cap=l.last) n FROM l JOIN steps s USING (fq_no, chain_no) GROUP BY ALL),
    m AS (SELECT *, CASE WHEN last IN ('Perception','Data_extraction') THEN 3 ELSE 2 END most,
      CASE last WHEN 'Perception' THEN 'Data_extraction' WHEN 'Data_extraction' THEN 'Calculation_analysis' WHEN 'Calculation_analysis' THEN 'Pattern_recognition'
        WHEN 'Pattern_recognition' THEN 'Logical_reasoning' WHEN 'Logical_reasoning' THEN 'Decision_support' ELSE 'Decision_support' END follower FROM n)
    SELECT fq_no::BIGINT fq_no, chain_no, CASE WHEN n>=most THEN follower ELSE last END current_capability, follower next_capability,
      CASE WHEN last<>'Decision_support' AND n=most-1 THEN 1 ELSE 0 END::BIGINT hint FROM m""",
)
def e11(spark, sf):
    names = F.array(*[F.lit(c) for c in ps.CAPABILITIES])
    log = _log(spark, sf).withColumn("capability", F.get(names, F.expr("least(pos div 2 + fq_no % 4, 5)").cast("int")))
    return tr.next_capability(log, ["fq_no", "chain_no"])


UCT = """uct AS (SELECT t.fq_no, t.parent_node_no, t.question_node_no, t.victory_count/t.visit_count::DOUBLE+sqrt(2.0::DOUBLE)*sqrt(ln(s.total)/t.visit_count) score
  FROM tree t JOIN (SELECT fq_no, parent_node_no, sum(visit_count)::DOUBLE total FROM tree GROUP BY ALL) s USING (fq_no, parent_node_no))"""


@query(
    "e12_uct_scores",
    f"{R}, {UCT} SELECT fq_no::BIGINT fq_no, question_node_no::BIGINT question_node_no, round(score,6) uct FROM uct",
)
def e12(spark, sf):
    return tr.uct_scores(_nodes(spark, sf)).select("fq_no", "question_node_no", F.round("uct", 6).alias("uct"))


@query(
    "e12_select_child",
    f"""{R}, {UCT}, r AS (SELECT *, row_number() OVER (PARTITION BY fq_no, parent_node_no ORDER BY score DESC, question_node_no) k FROM uct)
    SELECT fq_no::BIGINT fq_no, parent_node_no::BIGINT parent_node_no, question_node_no::BIGINT question_node_no, round(score,6) uct FROM r WHERE k=1""",
)
def e12s(spark, sf):
    return tr.select_child(tr.uct_scores(_nodes(spark, sf))).withColumn("uct", F.round("uct", 6))


@query(
    "e12_ucb_select_child",
    f"""{R}, v AS (SELECT fq_no, question_node_no, parent_node_no, victory_count visit_count, victory_count//2 victory_count FROM tree),
    s AS (SELECT v.fq_no, v.parent_node_no, v.question_node_no, CASE WHEN v.visit_count=0 THEN 1e300 ELSE v.victory_count/v.visit_count::DOUBLE+sqrt(2.0::DOUBLE)*sqrt(ln(greatest(coalesce(p.visit_count,1),1)::DOUBLE)/v.visit_count) END score
      FROM v LEFT JOIN v p ON p.fq_no=v.fq_no AND p.question_node_no=v.parent_node_no),
    r AS (SELECT *, row_number() OVER (PARTITION BY fq_no, parent_node_no ORDER BY score DESC, question_node_no) k FROM s)
    SELECT fq_no::BIGINT fq_no, parent_node_no::BIGINT parent_node_no, question_node_no::BIGINT question_node_no FROM r WHERE k=1""",
)
def e12u(spark, sf):
    nodes = _nodes(spark, sf).withColumn("visit_count", F.col("victory_count")).withColumn(
        "victory_count", F.expr("visit_count div 2")
    )
    return tr.select_child(tr.ucb_scores(nodes)).drop("uct")


@query(
    "e13_reuse_probability",
    f"""{R} SELECT t.fq_no::BIGINT fq_no, t.question_node_no::BIGINT question_node_no, round(1/(1+exp(-(count(c.question_node_no)-5.0::DOUBLE))),6) reuse_probability
    FROM tree t LEFT JOIN tree c ON c.fq_no=t.fq_no AND c.parent_node_no=t.question_node_no GROUP BY t.fq_no, t.question_node_no""",
)
def e13(spark, sf):
    p = tr.reuse_probability(tr.child_counts(_nodes(spark, sf)))
    return p.select("fq_no", "question_node_no", F.round("reuse_probability", 6).alias("reuse_probability"))


@query("e15_next_no", f"{R} SELECT fq_no::BIGINT fq_no, (max(question_node_no)+1)::BIGINT next_no FROM tree GROUP BY fq_no")
def e15(spark, sf):
    return tr.next_numbers(_nodes(spark, sf), ["fq_no"], "question_node_no")


@query(
    "e17_deficit_fill",
    f"""{R}, h AS (SELECT q.fq_no, count(t.fq_no) n FROM (SELECT DISTINCT fq_no FROM tree) q LEFT JOIN tree t ON t.fq_no=q.fq_no AND t.parent_node_no=0 GROUP BY q.fq_no)
    SELECT fq_no::BIGINT fq_no, unnest(range(1, 21-n)) slot FROM h WHERE n<20""",
)
def e17(spark, sf):
    nodes = _nodes(spark, sf)
    return tr.deficit_fill(nodes.select("fq_no").distinct(), nodes.where("parent_node_no = 0"), ["fq_no"])


REL = """rel AS (SELECT fq_no, "no" question_node_no, count(*) n_chains, avg(correct::INT::DOUBLE) reliability, avg((NOT correct AND NOT node_ok)::INT::DOUBLE) sensitivity FROM log GROUP BY ALL)"""


@query(
    "d24_chain_quality",
    f"{R}, {REL} SELECT fq_no::BIGINT fq_no, question_node_no::BIGINT question_node_no, n_chains, round(reliability,6) reliability, round(sensitivity,6) sensitivity, reliability>=0.8 is_good FROM rel",
)
def d24(spark, sf):
    r = tr.node_reliability(_log(spark, sf))
    return r.withColumn("reliability", F.round("reliability", 6)).withColumn("sensitivity", F.round("sensitivity", 6))


@query(
    "d24_chain_completeness",
    f"{R} SELECT fq_no::BIGINT fq_no, chain_no, round(coalesce(avg(linked::INT::DOUBLE) FILTER (pos>0),1),6) completeness FROM log GROUP BY ALL",
)
def d24c(spark, sf):
    return tr.chain_completeness(_log(spark, sf), ["fq_no", "chain_no"]).withColumn(
        "completeness", F.round("completeness", 6)
    )


@query(
    "h08_prune_nodes",
    f"""{R}, {REL}, bad AS (SELECT fq_no, question_node_no FROM rel WHERE reliability<0.5),
    lost AS (SELECT DISTINCT p.fq_no, p.node FROM (SELECT fq_no, node, unnest(path) x FROM paths) p JOIN bad b ON b.fq_no=p.fq_no AND b.question_node_no=p.x)
    SELECT t.fq_no::BIGINT fq_no, t.question_node_no::BIGINT question_node_no FROM tree t LEFT JOIN lost l ON l.fq_no=t.fq_no AND l.node=t.question_node_no WHERE l.node IS NULL""",
)
def h08(spark, sf):
    rel = tr.node_reliability(_log(spark, sf))
    return tr.prune_nodes(_nodes(spark, sf), rel, 0.5).select("fq_no", "question_node_no")


@query(
    "h02_built_questions",
    """SELECT o_custkey, count(DISTINCT o_orderkey) n_questions, count(DISTINCT l_orderkey) n_built, min(o_orderkey) FILTER (l_orderkey IS NULL) next_no,
    count(DISTINCT l_orderkey)=count(DISTINCT o_orderkey) all_built FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY o_custkey""",
)
def h02(spark, sf):
    q = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    trees = q.join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    return tr.built_questions(q, trees, "o_custkey", "o_orderkey")


@query(
    "h04_init_roots",
    "SELECT o_orderkey fq_no, 0::BIGINT question_node_no, -1::BIGINT parent_node_no, 1::BIGINT visit_count, 0::BIGINT victory_count FROM orders",
)
def h04(spark, sf):
    return tr.init_roots(table(spark, sf, "orders").select(F.col("o_orderkey").alias("fq_no")), ["fq_no"])


@query(
    "h04_number_nodes",
    "SELECT user_id fq_no, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 question_node_no FROM events",
)
def h04n(spark, sf):
    nodes = table(spark, sf, "events").select(F.col("user_id").alias("fq_no"), "event_id", "ts")
    return tr.number_nodes(nodes, ["ts", "event_id"]).drop("ts")


def _steps(spark, sf):
    return fx.with_options(
        _log(spark, sf).withColumn("question", F.concat(F.lit("Question "), F.col("no").cast("string")))
    )


FACT = "CASE answer WHEN 'A' THEN 'rises'||chr(10) ELSE 'rises'||chr(10)||'stays flat'||chr(10) END"


@query(
    "h03_chain_facts",
    f"""{R} SELECT fq_no::BIGINT fq_no, chain_no, pos::BIGINT pos, 'QA_Node_'||CAST(pos+1 AS VARCHAR)||'_Content' AS "name", 'Question '||CAST("no" AS VARCHAR) question, {FACT} answer_text FROM log""",
)
def h03(spark, sf):
    return tr.chain_facts(_steps(spark, sf), ["fq_no", "chain_no"])


@query(
    "h07_build_sft",
    f"""{R}, s AS (SELECT *, 'Question '||CAST("no" AS VARCHAR) q, {FACT} a FROM log)
    SELECT fq_no::BIGINT fq_no, chain_no, arg_max(q, pos) instruction, string_agg('Step '||CAST(pos+1 AS VARCHAR)||': '||q||chr(10)||'Answer: '||a, chr(10) ORDER BY pos)||chr(10)||'Final answer: '||arg_max(a, pos) AS output FROM s GROUP BY ALL""",
)
def h07(spark, sf):
    return tr.build_sft(tr.chain_facts(_steps(spark, sf), ["fq_no", "chain_no"]), ["fq_no", "chain_no"])


@query(
    "h07_build_sft_plain",
    f"""{R}, s AS (SELECT *, 'Question '||CAST("no" AS VARCHAR) q, {FACT} a FROM log)
    SELECT fq_no::BIGINT fq_no, chain_no, arg_max(q, pos) instruction, arg_max(a, pos) AS output FROM s GROUP BY ALL""",
)
def h07p(spark, sf):
    return tr.build_sft(tr.chain_facts(_steps(spark, sf), ["fq_no", "chain_no"]), ["fq_no", "chain_no"], cot=False)


@query(
    "h09_stop_chain",
    f"""{R}, {NEXT_LOG}, c AS (SELECT s.fq_no, s.chain_no, arg_max(s.cap, s.pos) last_capability, count(*)-1 n_entries, bool_or(l.can_answer_finalq) sufficient
      FROM steps s JOIN log l ON l.fq_no=s.fq_no AND l.chain_no=s.chain_no AND l.pos=s.pos GROUP BY ALL)
    SELECT fq_no::BIGINT fq_no, chain_no, last_capability='Decision_support' AND (sufficient OR n_entries>=20) chain_complete,
      last_capability='Decision_support' AND (sufficient OR n_entries>=20) AND chain_no>=20 tree_complete FROM c""",
)
def h09(spark, sf):
    names = F.array(*[F.lit(c) for c in ps.CAPABILITIES])
    log = _log(spark, sf).withColumn("capability", F.get(names, F.expr("least(pos div 2 + fq_no % 4, 5)").cast("int")))
    chains = log.groupBy("fq_no", "chain_no").agg(
        F.max_by("capability", "pos").alias("last_capability"),
        (F.count("*") - 1).alias("n_entries"),
        F.bool_or("can_answer_finalq").alias("sufficient"),
    )
    return tr.stop_chains(chains).select("fq_no", "chain_no", "chain_complete", "tree_complete")


@query("h10_any_can_answer", f"{R} SELECT fq_no::BIGINT fq_no, chain_no, bool_or(can_answer_finalq) can_answer FROM log GROUP BY ALL")
def h10(spark, sf):
    return tr.any_can_answer(_log(spark, sf), ["fq_no", "chain_no"])


@query(
    "d23_dataset_card",
    f"""{R}, c AS (SELECT count(*) n FROM log GROUP BY fq_no, chain_no) SELECT (SELECT count(*) FROM log) n_samples, (SELECT count(*) FROM c) n_chains,
    (SELECT round(avg(n),2) FROM c) mean_chain_length, """
    + ", ".join(f"(SELECT round(100.0::DOUBLE*count(*) FILTER (capability='{c}')/count(*),2) FROM log) pct_{c.lower()}" for c in ps.CAPABILITIES),
)
def d23(spark, sf):
    return tr.dataset_card(_log(spark, sf), ["fq_no", "chain_no"])
