import numpy as np
import pytest
from pyspark.sql import functions as F

from gapscope.operators import irt as M


def _planted(spark, seed=3, n_models=6, n_items=30):
    rng = np.random.default_rng(seed)
    subsets = ["english_ca", "greek_ca", "greek_cs", "greek_cs_en"]
    theta = {(f"m{j}", s): rng.normal() for j in range(n_models) for s in subsets}
    b = {i: rng.normal() for i in range(n_items)}
    rows = []
    for (m, s), t in theta.items():
        for i, bi in b.items():
            rows.append((m, s, i, bool(rng.random() < 1 / (1 + np.exp(-(t - bi))))))
    rows += [("perfect", "greek_ca", i, True) for i in range(n_items)]     # all-right examinee
    df = spark.createDataFrame(rows, "model string, subset string, item long, correct boolean")
    return M.irt_responses(df)


def test_item_keys_shared_across_prompt_languages(spark):
    r = _planted(spark)
    keys = {x.item_key.split("::")[0] + ("::" + x.item_key.split("::")[1] if x.item_key.startswith("cs") else "")
            for x in r.select("item_key").distinct().collect()}
    assert keys == {"ca", "cs::greek"}


def test_components(spark):
    comp = M.irt_components(_planted(spark))
    e = {r.node: r.component for r in comp.where("kind = 'e'").collect()}
    assert e["m0|english_ca"] == e["m0|greek_ca"] != e["m0|greek_cs"] == e["m1|greek_cs_en"]


def test_fit_score_equations_and_anchor(spark):
    resp = _planted(spark)
    fit = M.rasch_fit(resp, tol=1e-8, max_iter=300)
    assert fit.converged
    ex = {(r.kind, r.node, r.reason) for r in fit.excluded.collect()}
    assert ("e", "perfect|greek_ca", "all_right") in ex
    th = fit.theta.toPandas()
    b = fit.b.toPandas()
    # anchored: mean theta 0 per component
    assert th.groupby("component")["theta"].mean().abs().max() < 1e-9
    # score equations: sum y = sum P for every examinee and item
    d = (resp.join(fit.theta.select("model", "subset", "theta"), ["model", "subset"])
         .join(fit.b.select("item_key", "b"), "item_key")
         .withColumn("p", 1 / (1 + F.exp(F.col("b") - F.col("theta")))))
    pe = d.groupBy("model", "subset").agg(F.sum("y").alias("s"), F.sum("p").alias("p")).toPandas()
    pi = d.groupBy("item_key").agg(F.sum("y").alias("s"), F.sum("p").alias("p")).toPandas()
    assert (pe.s - pe.p).abs().max() < 1e-5
    assert (pi.s - pi.p).abs().max() < 1e-5


def test_fit_matches_numpy_jmle(spark):
    resp = _planted(spark, seed=11, n_models=4, n_items=20)
    fit = M.rasch_fit(resp, tol=1e-9, max_iter=400)
    pdf = resp.toPandas()
    pdf["e"] = pdf.model + "|" + pdf.subset
    while True:                                 # trim all-right / all-wrong examinees and items
        ge = pdf.groupby("e").y.agg(["sum", "count"])
        gi = pdf.groupby("item_key").y.agg(["sum", "count"])
        bad_e = ge.index[(ge["sum"] == 0) | (ge["sum"] == ge["count"])]
        bad_i = gi.index[(gi["sum"] == 0) | (gi["sum"] == gi["count"])]
        if len(bad_e) == 0 and len(bad_i) == 0:
            break
        pdf = pdf[~pdf.e.isin(bad_e) & ~pdf.item_key.isin(bad_i)]
    pdf["comp"] = pdf.item_key.str.extract(r"^(ca|cs::[^:]+)")[0]
    e_idx = {e: k for k, e in enumerate(sorted(pdf.e.unique()))}
    i_idx = {i: k for k, i in enumerate(sorted(pdf.item_key.unique()))}
    E, I = pdf.e.map(e_idx).to_numpy(), pdf.item_key.map(i_idx).to_numpy()
    y = pdf.y.to_numpy(float)
    th, bb = np.zeros(len(e_idx)), np.zeros(len(i_idx))
    for _ in range(2000):                       # brute force: plain alternating Newton
        p = 1 / (1 + np.exp(-(th[E] - bb[I])))
        th += np.clip(np.bincount(E, y - p) / np.bincount(E, p * (1 - p)), -1, 1)
        p = 1 / (1 + np.exp(-(th[E] - bb[I])))
        bb += np.clip(np.bincount(I, p - y) / np.bincount(I, p * (1 - p)), -1, 1)
    comp_e = pdf.groupby("e").comp.first()
    for c in comp_e.unique():
        members = [e_idx[e] for e in comp_e[comp_e == c].index]
        shift = th[members].mean()
        th[members] -= shift
        items = [i_idx[i] for i in pdf[pdf.comp == c].item_key.unique()]
        bb[items] -= shift
    got = {f"{r.model}|{r.subset}": r.theta for r in fit.theta.collect()}
    for e, k in e_idx.items():
        assert got[e] == pytest.approx(th[k], abs=1e-5)


def test_rasch_nll_at_zero(spark):
    r = _planted(spark, n_models=2, n_items=5)
    theta = r.select("model", "subset").distinct().withColumn("theta", F.lit(0.0))
    b = r.select("item_key").distinct().withColumn("b", F.lit(0.0))
    out = M.rasch_nll(r, theta, b).first()
    assert out.nll == pytest.approx(out.n * np.log(2))


def test_component_report_flags_disconnected_design(spark):
    # two examinees answer disjoint CA items: the key-derived 'ca' component is split
    rows = [("m1", "english_ca", i, i % 2 == 0) for i in range(4)] + \
           [("m2", "greek_ca", 10 + i, i % 2 == 0) for i in range(4)]
    resp = M.irt_responses(spark.createDataFrame(rows, "model string, subset string, item long, correct boolean"))
    rep = M.component_report(M.irt_components(resp)).collect()
    assert len(rep) == 2 and {r.status for r in rep} == {"split"} and {r.key_component for r in rep} == {"ca"}


def test_components_of_a_long_chain_and_bars_in_names(spark):
    n = 130
    rows = [(f"m{i:03}", "x_ca", f"ca::{j:03}", (i + j) % 2) for i in range(n) for j in (i, i + 1)]
    rows += [("a|b", "c_ca", "ca::900", 1), ("a", "b|c_ca", "ca::901", 1)]
    comp = M.irt_components(spark.createDataFrame(rows, "model string, subset string, item_key string, y int"))
    assert {r.component for r in comp.where("node like 'm%'").collect()} == {"ca::000"}
    assert comp.where("kind = 'e'").count() == n + 2


def test_unconverged_fit_raises_and_the_log_has_every_loss(spark):
    with pytest.raises(M.NotConverged):
        M.rasch_fit(_planted(spark), tol=1e-12, max_iter=2)
    log = M.rasch_fit(_planted(spark), tol=3e-2, task_rows=0).log
    assert all(b["nll"] <= a["nll"] + 1e-9 for a, b in zip(log, log[1:])) and len(log) > 1
    assert M.rasch_converged([{"nll": 5.0 + 1e-9 * i} for i in range(102)]) and not M.rasch_converged(log[:2])


def test_trimming_goes_on_until_nothing_is_extreme(spark):
    # a staircase: each round only its ends are all right or all wrong
    n = 24
    rows = [(f"e{i:02}", f"i{j:02}", int(i > j)) for i in range(n) for j in range(n) if abs(i - j) <= 2 and i != j]
    kept, gone = M.trim_extremes(spark.createDataFrame(rows, "e string, i string, y int"))
    for k in ("e", "i"):
        assert kept.groupBy(k).agg(F.sum("y").alias("s"), F.count("y").alias("n")).where("s = 0 or s = n").count() == 0
    assert gone.agg(F.max("round")).first()[0] >= 2


def _resp(spark, rows):
    return spark.createDataFrame([(m, "greek_ca", f"ca::{i}", y) for m, i, y in rows], "model string, subset string, item_key string, y int")


def _in_tasks(spark, rows):
    fit = M.rasch_fit(_resp(spark, rows), tol=1e-9)
    values = {(r.model, r.component): r.theta for r in fit.theta.collect()} | {(r.item_key, r.component): r.b for r in fit.b.collect()}
    return values, {(r.kind, r.node, r.reason, r.round) for r in fit.excluded.collect()}


def _both(spark, rows):
    """The fit in tasks and by joins; both must agree."""
    one, two = M.rasch_fit(_resp(spark, rows), tol=1e-9), M.rasch_fit(_resp(spark, rows), tol=1e-9, task_rows=0)
    gone = [{(r.kind, r.node, r.reason, r.round) for r in f.excluded.collect()} for f in (one, two)]
    values = [{(r.model, r.component): r.theta for r in f.theta.collect()} | {(r.item_key, r.component): r.b for r in f.b.collect()} for f in (one, two)]
    assert gone[0] == gone[1] and values[0].keys() == values[1].keys()
    assert all(values[0][k] == pytest.approx(values[1][k], abs=1e-6) for k in values[0])
    return values[0], gone[0]


def test_quasi_separated_block_is_excluded(spark):
    # strong models beat every easy item, weak ones lose to every hard item; each half alone is mixed, nobody is extreme
    rows = [(f"s{m}", f"h{i}", int((m + i) % 2 == 0)) for m in range(4) for i in range(3)] + [(f"s{m}", f"e{i}", 1) for m in range(4) for i in range(2)]
    rows += [(f"w{m}", f"e{i}", int((m + i) % 2 == 0)) for m in range(3) for i in range(2)] + [(f"w{m}", f"h{i}", 0) for m in range(3) for i in range(3)]
    kept, gone = M.trim_extremes(_resp(spark, rows).select(F.col("model").alias("e"), F.col("item_key").alias("i"), "y"))
    assert kept.count() == len(rows) and gone.count() == 0             # trimming alone finds nothing, and the estimate diverges
    values, gone = _both(spark, rows)
    assert {g[1].split("|")[0] for g in gone} == {"w0", "w1", "w2", "ca::e0", "ca::e1"} and {g[2] for g in gone} == {"quasi_separated"}
    assert {k[1] for k in values} == {"ca::h0"} and max(abs(v) for v in values.values()) < 5


def test_chain_of_blocks_and_separate_components(spark):
    ring = lambda p, n: [(f"{p}m{k}", f"{p}i{k}", 1) for k in range(n)] + [(f"{p}m{k}", f"{p}i{(k + 1) % n}", 0) for k in range(n)]
    rows = ring("a", 3) + ring("b", 5) + ring("c", 4) + [("am0", "bi0", 1), ("bm0", "ci0", 1)] + ring("z", 4) + [("all", "zi0", 1)]
    values, gone = _in_tasks(spark, rows)
    assert {k[1] for k in values} == {"ca::bi0", "ca::zi0"}
    assert ("e", "all|greek_ca", "all_right", 0) in gone
    assert sum(g[2] == "quasi_separated" for g in gone) == 2 * (3 + 4)


def test_complete_blocks_collapse_to_score_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(f"m{m}", f"{i}", int(rng.random() < 1 / (1 + np.exp((i - m / 4) / 3)))) for m in range(40) for i in range(12)]
    kept = M.estimable_blocks(M.trim_extremes(_resp(spark, rows).select(F.col("model").alias("e"), F.col("item_key").alias("i"), "y"))[0])[0]
    cells, e, i = M.score_cells(kept)
    n_e, n_i = e.count(), i.count()
    assert kept.count() == n_e * n_i and cells.count() <= 13 * n_i < kept.count()
    assert cells.agg(F.sum(F.col("we") * F.col("wi"))).first()[0] == n_e * n_i
    values, _ = _in_tasks(spark, rows)
    # one answer less: the same component is fitted response by response
    theta = {k: v for k, v in values.items() if k[0].startswith("m")}
    plain = M.score_cells(kept.where("not (e = 'm20' and i = 'ca::5')"))[0]
    assert plain.count() == n_e * n_i - 1 and len(theta) == n_e
    score = {r.node: r.score for r in e.collect()}
    assert len({round(v, 6) for v in theta.values()}) == len(set(score.values()))


def test_strong_components_against_closure(spark):
    import random

    from gapscope.functions.strong import strong_components
    from gapscope.operators.rasch_task import strong_labels
    r = random.Random(4)
    for n, m, spread in ((8, 18, True), (12, 16, False), (30, 45, False), (30, 200, False), (5, 0, False)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        reach = [[i == j for j in range(n)] for i in range(n)]
        for a, b in edges:
            reach[a][b] = True
        for k in range(n):
            for i in range(n):
                for j in range(n):
                    reach[i][j] |= reach[i][k] and reach[k][j]
        want = {i: min(j for j in range(n) if reach[i][j] and reach[j][i]) for i in range(n)}
        sizes = {w: sum(x == w for x in want.values()) for w in want.values()}
        if spread:
            df = spark.createDataFrame([("p", f"{a:02}", f"{b:02}") for a, b in edges], "part string, u string, v string")
            got = {int(x.node): int(x.block) for x in strong_components(df).collect()}
            assert got == {i: w for i, w in want.items() if sizes[w] > 1} and got
        u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        label = strong_labels(n, u, v).tolist()
        assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(n) for j in range(n))


def test_loss_rule_stops_a_fit(spark):
    rows = [(f"m{m}", f"{i}", (m * i + m + i) % 3 % 2) for m in range(9) for i in range(8)]
    short = M.rasch_fit(_resp(spark, rows), tol=0.0, max_iter=130, rule="loss")
    long = M.rasch_fit(_resp(spark, rows), tol=1e-9)
    a, b = ({r.model: r.theta for r in f.theta.collect()} for f in (short, long))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-3) for k in a)
    with pytest.raises(M.NotConverged):
        M.rasch_fit(_resp(spark, rows), tol=0.0, max_iter=90, rule="loss")


def test_chunks_fit_as_one_task_does_and_send_items_not_responses(spark, monkeypatch):
    from gapscope.operators import rasch_chunks
    monkeypatch.setattr(rasch_chunks, "CHUNK_ROWS", 150)
    rng = np.random.default_rng(7)
    rows = [(rf"m\|{m}", f"{i:02}", int(rng.random() < 1 / (1 + np.exp((i - m / 2) / 6)))) for m in range(40) for i in range(20) if rng.random() < 0.7]
    rows += [("all", f"{i:02}", 1) for i in range(5)] + [("top", "90", 0), ("top", "91", 1), ("top2", "90", 1), ("top2", "91", 0), ("top", "00", 1)]
    sent = []
    real = rasch_chunks.Chunks.exchange
    monkeypatch.setattr(rasch_chunks.Chunks, "exchange", lambda self, state, *a: sent.append((self, state)) or real(self, state, *a))
    values, gone = _both(spark, rows)
    assert len(values) > 50 and ("e", "all|greek_ca", "all_right", 0) in gone and {g[2] for g in gone} >= {"all_right", "quasi_separated"}
    assert any(k[0] == r"m\|7" for k in values)
    chunks = sent[0][0]
    assert chunks.packed.count() > 1 and len(sent) > 5
    # a step sends a row per item of a chunk at most, fewer than there are responses
    assert chunks.route.count() <= 22 * chunks.packed.count() < len(rows)
