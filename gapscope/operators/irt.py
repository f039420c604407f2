"""Rasch / one-parameter logistic model as distributed Spark jobs.

P(y=1 | theta_e, b_i) = sigmoid(theta_e - b_i).  Examinee e = (model, subset);
items are shared across prompt languages (``ca::<item>`` over all ``*_ca``
subsets, ``cs::<locale>::<item>`` over ``<locale>_cs`` and ``<locale>_cs_en``).

Fit (joint maximum likelihood, no prior):

* responses are reduced to (e, i, y) and written once to the shared checkpoint folder;
* examinees / items with all-right or all-wrong answers have no finite MLE; they are
  trimmed repeatedly and returned in ``excluded``;
* trimming is necessary, not sufficient: an estimate exists only where the directed
  graph of "beats" is strongly connected, so each component of the observed graph is cut
  to its largest strongly connected block (``estimable_blocks``);
* components carry the identification: theta is anchored to mean 0 per component;
* complete blocks depend on the scores only and collapse to score groups (``score_cells``);
* each iteration is a damped Newton step for every theta (items fixed), then for every b
  (thetas fixed).  Components of bounded size are iterated within a task; larger ones are
  dealt into chunks of examinees, which keep their responses and exchange sums per item
  (``rasch_chunks``).  Complete components, and those whose largest block is less than
  half of them, go through joins of the cells with both parameter tables and a partial and
  final aggregate; parameter tables are checkpointed (small, cuts lineage);
* the per-component anchor (mean theta 0) is applied once at the end, since the
  likelihood depends on theta - b only.

The log-likelihood is concave, so any convergent optimiser reaches the same anchored
point when a finite MLE exists.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.functions.components import components
from gapscope.functions.strong import strong_components
from gapscope.operators import rasch_chunks
from gapscope.operators.rasch_task import STEP_CLIP, connected_within, in_tasks
from gapscope.session import reliable_checkpoint, ship_package, staged

TASK_ROWS = 1_000_000            # responses of a connected component that one task may hold


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


# ---------------------------------------------------------------------------
# M1 irt_responses, M2 irt_components
# ---------------------------------------------------------------------------

def item_key(subset="subset", item="item") -> Column:
    """ca::<item> for *_ca subsets; cs::<locale>::<item> for <locale>_cs / _cs_en."""
    s = F.col(subset) if isinstance(subset, str) else subset
    it = (F.col(item) if isinstance(item, str) else item).cast("string")
    loc = F.regexp_extract(s, r"^(.+?)_(cs_en|cs)$", 1)
    return (F.when(s.endswith("_ca"), F.concat(F.lit("ca::"), it))
            .when(loc != "", F.concat(F.lit("cs::"), loc, F.lit("::"), it)))


def key_component(key="item_key") -> Column:
    """Component implied by the item key: 'ca' or 'cs::<locale>'."""
    k = F.col(key) if isinstance(key, str) else key
    return F.regexp_extract(k, r"^(ca|cs::.+?)::", 1)


def irt_responses(scored: DataFrame) -> DataFrame:
    """(model, subset, item_key, y) from scored responses (``correct``)."""
    return scored.select("model", "subset", item_key("subset", "item").alias("item_key"),
                         F.col("correct").cast("int").alias("y")).where(F.col("item_key").isNotNull())


def _examinee(df: DataFrame) -> DataFrame:
    """Adds the examinee's name ``model|subset``; a bar within the model is escaped, so names are unique."""
    return df.withColumn("e", F.concat_ws("|", F.regexp_replace("model", r"([\\\\|])", r"\\\\$1"), "subset"))


def observed_components(rows: DataFrame) -> DataFrame:
    """(node, root) of the connected graph of responses (e, i); nodes are ``i<item>`` and ``~<examinee>``.

    Examinees are dealt out first, and each task replaces its responses by links of every
    node to the least one that they connect it with, so that the steps between tasks start
    from (task, node) rows instead of responses.
    """
    ship_package(rows.sparkSession)
    # items sort before examinees, so the least node of a component is its smallest item
    edges = rows.select(F.concat(F.lit("i"), "i").alias("a"), F.concat(F.lit("~"), "e").alias("b")).where("a IS NOT NULL")
    return components(edges.repartition("b").mapInArrow(connected_within, "a string, b string"))


def irt_components(resp: DataFrame) -> DataFrame:
    """M2: connected components of the examinee-item graph.

    Returns (node, kind 'e'|'i', component) with component = smallest item key
    reachable.  Star steps until nothing changes: the number of rounds grows with
    the logarithm of the longest chain, and there is no cap on it.
    """
    found = observed_components(_examinee(resp).select("e", F.col("item_key").alias("i")))
    roots = found.select(F.col("root").alias("node"), "root").distinct()
    nodes = found.unionByName(roots)
    return nodes.select(F.expr("substr(node, 2)").alias("node"),
                        F.when(F.col("node").startswith("~"), "e").otherwise("i").alias("kind"),
                        F.expr("substr(root, 2)").alias("component"))


def component_report(components: DataFrame) -> DataFrame:
    """M2 check: observed components against the ones implied by the item keys.

    One row per (observed component, key component) with node counts; a key
    component spread over several observed ones (disconnected design) or an
    observed component spanning several key components is flagged.
    """
    items = components.where(F.col("kind") == "i").withColumn("key_component", key_component("node"))
    pairs = items.groupBy("component", "key_component").agg(F.count(F.lit(1)).alias("n_items"))
    n_obs = pairs.groupBy("key_component").agg(F.count(F.lit(1)).alias("n_observed"))
    n_key = pairs.groupBy("component").agg(F.count(F.lit(1)).alias("n_key"))
    return (pairs.join(n_obs, "key_component").join(n_key, "component")
            .withColumn("status", F.when(F.col("n_observed") > 1, "split")
                        .when(F.col("n_key") > 1, "merged").otherwise("ok")))


# ---------------------------------------------------------------------------
# M3 rasch_nll
# ---------------------------------------------------------------------------

def rasch_nll(resp: DataFrame, theta: DataFrame, b: DataFrame) -> DataFrame:
    """-sum[y(theta-b) - log(1+exp(theta-b))] (one row); theta (model, subset, theta), b (item_key, b)."""
    d = resp.join(theta, ["model", "subset"]).join(b, "item_key")
    x = F.col("theta") - F.col("b")
    # log(1+e^x) computed stably: max(x,0) + log1p(exp(-|x|))
    soft = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    return d.agg(F.sum(soft - F.col("y") * x).alias("nll"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# M4-M6 rasch_fit
# ---------------------------------------------------------------------------

@dataclass
class RaschFit:
    theta: DataFrame          # (model, subset, component, theta, score, n)
    b: DataFrame              # (item_key, component, b, score, n)
    excluded: DataFrame       # (kind, node, reason, round)
    log: list = field(default_factory=list)   # per-iteration dicts (driver scalars) of the distributed steps
    converged: bool = False


def trim_extremes(resp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop all-right / all-wrong examinees and items until none is left (no cap on the rounds).

    Returns (kept responses (e, i, y), excluded (kind, node, reason, round)).
    Each round reads the responses that the round before kept.
    """
    cur = resp
    excluded = resp.sparkSession.createDataFrame([], "kind string, node string, reason string, round int")
    rnd = 0
    while True:
        def extreme(kind: str, rows: DataFrame = cur, at: int = rnd) -> DataFrame:
            s = rows.groupBy(kind).agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
            return s.where((F.col("s") == 0) | (F.col("s") == F.col("n"))).select(
                F.lit(kind).alias("kind"), F.col(kind).alias("node"),
                F.when(F.col("s") == 0, "all_wrong").otherwise("all_right").alias("reason"), F.lit(at).alias("round"))
        bad = reliable_checkpoint(extreme("e").unionByName(extreme("i")))
        if bad.isEmpty():
            return cur, excluded
        excluded = excluded.unionByName(bad)
        cur = reliable_checkpoint(
            cur.join(bad.where(F.col("kind") == "e").select(F.col("node").alias("e")), "e", "left_anti")
            .join(bad.where(F.col("kind") == "i").select(F.col("node").alias("i")), "i", "left_anti"))
        rnd += 1


def estimable_blocks(resp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The part of trimmed responses (e, i, y) that has a finite estimate, and the rest as ``excluded``.

    Who answers right beats the item, who answers wrong is beaten by it.  The estimate of
    a connected component exists if and only if its graph of beats is strongly connected:
    otherwise some nodes beat all others wherever they meet, and the distance to them
    grows without end.  The strongly connected block of most nodes (ties: least node)
    stays in each component; nodes outside it are ``quasi_separated``.

    Returns ((component, e, i, y), excluded); component is the least item of the block.
    """
    # items sort before examinees, as in irt_components
    e, i = F.concat(F.lit("~"), "e"), F.concat(F.lit("i"), "i")
    parts = components(resp.select(i.alias("a"), e.alias("b")))
    roots = parts.unionByName(parts.select(F.col("root").alias("node"), "root").distinct())
    roots = reliable_checkpoint(roots.select("node", F.col("root").alias("part")))
    beats = resp.select(F.when(F.col("y") == 1, e).otherwise(i).alias("u"), F.when(F.col("y") == 1, i).otherwise(e).alias("v"))
    blocks = strong_components(beats.join(roots.withColumnRenamed("node", "u"), "u"))
    sized = roots.join(blocks, "node")
    chosen = sized.groupBy("part", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("part").agg(
        F.min_by("block", F.struct(-F.col("n"), "block")).alias("block"))
    stay = reliable_checkpoint(sized.join(chosen, ["part", "block"]).select("node", F.expr("substr(block, 2)").alias("component")))
    gone = roots.join(stay, "node", "left_anti").select(
        F.when(F.col("node").startswith("~"), "e").otherwise("i").alias("kind"), F.expr("substr(node, 2)").alias("node"),
        F.lit("quasi_separated").alias("reason"), F.lit(None).cast("int").alias("round"))
    of = lambda mark, name: stay.where(F.col("node").startswith(mark)).select(
        F.expr("substr(node, 2)").alias(name), F.col("component").alias(f"component_{name}"))
    kept = resp.join(of("~", "e"), "e").join(of("i", "i"), "i").where("component_e = component_i")
    return reliable_checkpoint(kept.select(F.col("component_e").alias("component"), "e", "i", "y")), gone


def score_cells(kept: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Responses (component, e, i, y) as the cells that a fit needs, complete components collapsed.

    Where every examinee answered every item, equal scores have equal estimates, so the
    component is as many cells as it has pairs of (examinee score, item score); elsewhere
    a cell is a response.  Returns (cells (ekey, ikey, we, wi), examinees and items, both
    (node, component, key, score, n)); we and wi are how many nodes a key stands for.
    """
    def nodes(kind: str) -> DataFrame:
        return kept.groupBy("component", F.col(kind).alias("node")).agg(F.sum("y").alias("score"), F.count(F.lit(1)).alias("n"))

    size = lambda df, name: df.groupBy("component").agg(F.count(F.lit(1)).alias(name), F.sum("n").alias("cells"))
    e, i = reliable_checkpoint(nodes("e")), reliable_checkpoint(nodes("i"))
    whole = size(e, "n_e").join(size(i, "n_i").drop("cells"), "component").select(
        "component", (F.col("cells") == F.col("n_e") * F.col("n_i")).alias("complete"))
    keyed = lambda df: reliable_checkpoint(df.join(whole, "component").withColumn(
        "key", F.when(F.col("complete"), F.concat(F.col("score").cast("string"), F.lit("@"), "component")).otherwise(F.concat(F.lit("="), "node"))))
    e, i = keyed(e), keyed(i)
    groups = lambda df, key, w: df.where("complete").groupBy("component", F.col("key").alias(key)).agg(F.count(F.lit(1)).alias(w))
    # group pairs: at most (scores + 1) x items of a component
    collapsed = groups(e, "ekey", "we").join(groups(i, "ikey", "wi"), "component").select("ekey", "ikey", "we", "wi")
    one = F.lit(1).cast("long")
    single = kept.join(whole.where("not complete"), "component", "left_semi").select(
        F.concat(F.lit("="), "e").alias("ekey"), F.concat(F.lit("="), "i").alias("ikey"), one.alias("we"), one.alias("wi"))
    return reliable_checkpoint(collapsed.unionByName(single)), e.drop("complete"), i.drop("complete")


class NotConverged(RuntimeError):
    """The fit's steps did not get below the tolerance within the allowed iterations."""


def _distributed_fit(resp: DataFrame, tol: float, max_iter: int, rule: str) -> tuple[DataFrame, DataFrame, DataFrame, list]:
    """(examinees, items, excluded, log) of responses (e, i, y): each step is a join of the cells with the parameters."""
    r, excluded = trim_extremes(resp)
    kept, separated = estimable_blocks(r)
    cells, e, i = score_cells(kept)
    keys = lambda df, v: df.groupBy("key").agg(F.max("score").alias("score"), F.max("n").alias("n"), F.count(F.lit(1)).alias("w")).select(
        "key", "score", "w", F.log(F.col("score") / (F.col("n") - F.col("score"))).alias(v))
    # start: logit of the examinee's proportion right; b from the item's proportion right
    theta = reliable_checkpoint(keys(e, "theta").withColumnRenamed("key", "ekey"))
    b = reliable_checkpoint(keys(i, "b").withColumn("b", -F.col("b")).withColumnRenamed("key", "ikey"))
    p, x = sigmoid(F.col("theta") - F.col("b")), F.col("theta") - F.col("b")
    soft = F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    clipped = F.greatest(F.lit(-STEP_CLIP), F.least(F.lit(STEP_CLIP), F.col("g") / F.col("h")))
    log: list = []
    for it in range(max_iter):
        # theta step (items fixed): one pass over the cells, partial aggregates per key
        st = cells.join(theta.select("ekey", "theta"), "ekey").join(b.select("ikey", "b"), "ikey").groupBy("ekey").agg(
            F.sum(F.col("wi") * p).alias("e"), F.sum(F.col("wi") * p * (1 - p)).alias("h"), F.sum(F.col("we") * F.col("wi") * soft).alias("soft"))
        new_theta = reliable_checkpoint(theta.join(st, "ekey").withColumn("g", F.col("score") - F.col("e")).select(
            "ekey", "score", "w", (F.col("theta") + clipped).alias("theta"), F.abs(clipped).alias("step"),
            (F.col("soft") - F.col("w") * F.col("score") * F.col("theta")).alias("nll")))
        # b step (thetas fixed)
        sb = cells.join(new_theta.select("ekey", "theta"), "ekey").join(b.select("ikey", "b"), "ikey").groupBy("ikey").agg(
            F.sum(F.col("we") * p).alias("e"), F.sum(F.col("we") * p * (1 - p)).alias("h"))
        new_b = reliable_checkpoint(b.join(sb, "ikey").withColumn("g", F.col("e") - F.col("score")).select(
            "ikey", "score", "w", (F.col("b") + clipped).alias("b"), F.abs(clipped).alias("step"),
            (F.col("w") * F.col("score") * F.col("b")).alias("nll")))
        at = new_theta.select("step", "nll").unionByName(new_b.select("step", "nll")).agg(F.max("step").alias("step"), F.sum("nll").alias("nll")).first()
        theta, b = new_theta.drop("step", "nll"), new_b.drop("step", "nll")
        log.append({"iter": it, "max_step": float(at.step or 0.0), "nll": float(at.nll or 0.0)})
        if log[-1]["max_step"] < tol or (rule == "loss" and rasch_converged(log)):
            break
    else:
        raise NotConverged(f"largest step {log[-1]['max_step']:.3g} after {max_iter} iterations, tolerance {tol:g}")
    theta = e.join(theta.select(F.col("ekey").alias("key"), F.col("theta").alias("value")), "key").drop("key")
    b = i.join(b.select(F.col("ikey").alias("key"), F.col("b").alias("value")), "key").drop("key")
    return theta, b, excluded.unionByName(separated), log


def _placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses (model, subset, e, i, y) with a ``part`` that no connected component leaves, parts' sizes (part, n)).

    The components that the item keys imply serve as parts if every examinee keeps to
    one of them, as it does where every subset does; otherwise the observed components are found.
    """
    keyed = rows.withColumn("part", key_component("i"))
    by_subset = reliable_checkpoint(keyed.groupBy("subset", "part").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("model").isNull() | F.col("subset").isNull()).alias("unnamed")))
    total = lambda df, n: df.groupBy("part").agg(n.alias("n"))
    if by_subset.where("part IS NOT NULL").groupBy("subset").count().where("count > 1").isEmpty() and by_subset.where("unnamed").isEmpty():
        return keyed, total(by_subset, F.sum("n"))
    mixed = keyed.groupBy("e").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi")
    if not mixed.isEmpty():
        parts = observed_components(rows)
        of_item = parts.where(F.col("node").startswith("i")).select(F.expr("substr(node, 2)").alias("i"), F.expr("substr(root, 2)").alias("part"))
        keyed = rows.join(of_item, "i", "left").withColumn("part", F.coalesce("part", "i"))       # a root is not listed
    return keyed, total(keyed, F.count(F.lit(1)))


def _large_fit(placed: DataFrame, sizes: DataFrame, tol: float, max_iter: int, rule: str) -> tuple[DataFrame, DataFrame, DataFrame, list]:
    """(examinees with model and subset, items, excluded, log) of parts that go through chunks."""
    ended = lambda log: log[-1]["max_step"] < tol or (rule == "loss" and rasch_converged(log))
    theta, b, excluded, rest, log = rasch_chunks.fit(rasch_chunks.pack(placed, sizes), tol, max_iter, ended)
    if log and not ended(log):
        raise NotConverged(f"largest step {log[-1]['max_step']:.3g} after {max_iter} iterations, tolerance {tol:g}")
    if rest is not None:
        theta_r, b_r, excluded_r, log_r = _distributed_fit(rest.select("e", "i", "y"), tol, max_iter, rule)
        of = rest.groupBy("e").agg(F.first("model").alias("model"), F.first("subset").alias("subset"))
        theta = theta.unionByName(theta_r.join(of.withColumnRenamed("e", "node"), "node").select(theta.columns))
        b, excluded, log = b.unionByName(b_r.select(b.columns)), excluded.unionByName(excluded_r), log + log_r
    return theta, b, excluded, log


def rasch_fit(resp: DataFrame, tol: float = 1e-6, max_iter: int = 500, task_rows: int = TASK_ROWS, rule: str = "step") -> RaschFit:
    """M4 (+M5 anchor, M6 convergence): joint MLE by alternating damped Newton steps.

    ``resp``: (model, subset, item_key, y).  Extremes are trimmed, then each connected
    component keeps its estimable block (``estimable_blocks``), complete blocks are fitted
    on score groups (``score_cells``).  A part of the graph of at most ``task_rows``
    responses goes through these steps in one task (``rasch_task``), a larger one through
    chunks of examinees that exchange sums with the items (``rasch_chunks``), or, where it is
    complete or its largest block is not at once known, through joins; all give the same
    result within ``tol``.

    Steps end when the largest parameter step is below ``tol``, or with ``rule='loss'``
    (M6) as soon as the loss changes relatively by less than 1e-5 over 100 steps;
    ``NotConverged`` is raised if that takes more than ``max_iter`` iterations.  ``log``
    has the loss (M3, at the parameters a step starts from) and size of every distributed step.
    """
    named = _examinee(staged(resp.select("model", "subset", F.col("item_key").alias("i"), F.col("y").cast("int").alias("y"))))
    placed, sizes = _placed(named)
    sizes = reliable_checkpoint(sizes.withColumn("large", F.col("n") > task_rows))
    large, small = (sizes.where(c).select("part", "n") for c in ("large", "NOT large"))
    theta = b = excluded = None
    log: list = []
    if large.isEmpty() or not small.isEmpty():
        bounded = placed if large.isEmpty() else placed.join(F.broadcast(large), "part", "left_anti")
        done = reliable_checkpoint(in_tasks(bounded.select("part", "e", "i", "y"), tol, max_iter, rule))
        if not done.where("reason = 'not_converged'").isEmpty():
            raise NotConverged(f"a component of at most {task_rows} responses, {max_iter} iterations, tolerance {tol:g}")
        names = bounded.groupBy("e").agg(F.first("model").alias("model"), F.first("subset").alias("subset")).withColumnRenamed("e", "node")
        out = lambda kind: done.where((F.col("kind") == kind) & F.col("reason").isNull()).select("node", "component", "score", "n", "value")
        theta, b = out("e").join(names, "node"), out("i")
        excluded = done.where(F.col("reason").isNotNull()).select("kind", "node", "reason", "round")
    if not large.isEmpty():
        theta_l, b_l, excluded_l, log = _large_fit(placed, large, tol, max_iter, rule)
        union = lambda one, two: two if one is None else one.unionByName(two)
        theta, b, excluded = reliable_checkpoint(union(theta, theta_l)), reliable_checkpoint(union(b, b_l)), union(excluded, excluded_l)
    # M5: anchor once at the end; the likelihood only depends on theta - b, so shifting a
    # component's thetas and bs by its mean theta changes nothing else
    mean_t = theta.groupBy("component").agg(F.avg("value").alias("mt"))
    shifted = lambda df, name: df.join(mean_t, "component").withColumn(name, F.col("value") - F.col("mt"))
    theta_out = shifted(theta, "theta").select("model", "subset", "component", "theta", "score", "n")
    b_out = shifted(b, "b").select(F.col("node").alias("item_key"), "component", "b", "score", "n")
    return RaschFit(theta_out, b_out, excluded, log, True)


def rasch_converged(log: list, window: int = 100, rel_tol: float = 1e-5) -> bool:
    """M6 (reference rule): relative loss change over ``window`` steps below ``rel_tol``."""
    losses = [x["nll"] for x in log[-window - 1:] if "nll" in x]
    if len(losses) <= window:
        return False
    return abs(losses[0] - losses[-1]) / max(abs(losses[0]), 1e-12) < rel_tol


# ---------------------------------------------------------------------------
# M7-M10 theta views
# ---------------------------------------------------------------------------

def theta_long(theta: DataFrame, dim_model: DataFrame | None = None) -> DataFrame:
    """theta as a long score table (metric 'theta') for the gap operators."""
    from gapscope.operators.metrics import with_country, with_subset_parts
    t = theta.select("model", "subset", F.lit("theta").alias("metric"), F.col("theta").alias("value"))
    t = with_country(t, dim_model) if dim_model is not None else t.withColumn("country", F.lit("Unknown"))
    return with_subset_parts(t)


def theta_gaps(theta: DataFrame, dim_model: DataFrame | None = None) -> DataFrame:
    """M7: G1 on theta: global = theta(local CA) - theta(english CA), local = theta(CS) - theta(CS_EN)."""
    from gapscope.operators.metrics import gaps_long
    return gaps_long(theta_long(theta, dim_model), metric="theta")


def theta_gaps_standardized(theta: DataFrame, dim_model: DataFrame | None = None) -> DataFrame:
    """M8 (our definition, the study gives none): each within-component gap
    divided by the population SD of theta in the examinee's own component
    (its ``<locale>_ca`` or ``<locale>_cs`` row's), then
    knowledge = local_std - global_std.  Raw gaps are kept beside it."""
    g = theta_gaps(theta, dim_model)
    sd = theta.groupBy("component").agg(F.stddev_pop("theta").alias("sd"))
    own = theta.join(sd, "component").select(
        "model", F.regexp_extract("subset", r"^(.+?)_(ca|cs)$", 1).alias("locale"),
        F.regexp_extract("subset", r"^(.+?)_(ca|cs)$", 2).alias("kind"), "sd")
    of = lambda kind: own.where(F.col("kind") == kind).select("model", "locale", F.col("sd").alias(f"sd_{kind}"))
    out = g.join(of("cs"), ["model", "locale"], "left").join(of("ca"), ["model", "locale"], "left")
    gs = F.col("global_gap") / F.col("sd_ca")
    ls = F.col("local_gap") / F.col("sd_cs")
    return out.withColumns({"global_gap_std": gs, "local_gap_std": ls, "knowledge_gap_std": ls - gs})


def item_characteristics(resp: DataFrame, theta: DataFrame, b: DataFrame, bins: int = 10) -> DataFrame:
    """M9: observed vs predicted proportion right per item and ability bin
    (equal-width bins of theta between its min and max)."""
    lo, hi = theta.agg(F.min("theta"), F.max("theta")).first()
    width = ((hi - lo) / bins) if hi is not None and hi > lo else 1.0
    d = resp.join(theta.select("model", "subset", "theta"), ["model", "subset"]).join(
        b.select("item_key", "b"), "item_key")
    binc = F.least(F.floor((F.col("theta") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return d.groupBy("item_key", binc.alias("ability_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("observed"),
        F.avg(sigmoid(F.col("theta") - F.col("b"))).alias("predicted"))


def accuracy_vs_theta(acc_gaps: DataFrame, th_gaps: DataFrame) -> DataFrame:
    """Raw-accuracy gaps beside theta gaps per (model, locale)."""
    a = acc_gaps.select("model", "country", "locale", *[F.col(c).alias(f"acc_{c}") for c in
                                                       ("global_gap", "local_gap", "knowledge_gap")])
    t = th_gaps.select("model", "locale", *[F.col(c).alias(f"theta_{c}") for c in
                                            ("global_gap", "local_gap", "knowledge_gap")])
    return a.join(t, ["model", "locale"], "left")
