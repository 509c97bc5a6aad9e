"""Recurrent language model, fill-in-the-middle and centroids against brute force."""

import hashlib
import math
import random
import re
import statistics
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import elkan, fill_middle, gru_lm, queries

from test_operators import DOCS, ODD

NAMES = ("word", "n", "row", "others", "held_out", "score", "body", "form", "prefix", "cut", "h1", "cluster", "v", "upper", "c")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("extra") for c in NAMES})


# --- op12 ------------------------------------------------------------------------
def plain_cuts(text, ident, seed=42):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"{seed}:{ident if ident is not None else ''}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
        return n, "plain", None, None, text
    pre, mid, suf = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if d % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_middle_equals_brute_force(spark, odd):
    rng = random.Random(4)
    made = [(100 + i, "".join(rng.choice(["a", "é", "😀", " ", "\n", "\t", "\x0b", " ", "<", "P>", "S>", "<S"]) for _ in range(rng.randint(0, 60)))) for i in range(600)]
    rows = [(r[0], r[1]) for r in ODD] + made
    df = odd.select("doc_id", "text", *NAMES).unionByName(spark.createDataFrame(made, "doc_id long, text string"), allowMissingColumns=True)
    out = fill_middle.transform_documents(df).withColumn("again", fill_middle.restored(F.col("output"), F.col("form")))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in out.collect())
    assert got == Counter((i, *plain_cuts(t or "", i), t or "") for i, t in rows)
    assert {k[2] for k in got} == {"plain", "psm", "spm"}


def test_runs_cut_at_characters_and_tokens():
    text = "ab  cd\n e \t"
    units = re.findall(r"\s*\S+|\s+", text)
    runs = fill_middle.Runs(text)
    assert len(runs) == len(units) == 4
    assert [runs.offset(u) for u in range(5)] == [len("".join(units[:u])) for u in range(5)]
    letters = fill_middle.Runs(text, "character")
    assert len(letters) == len(text) and [letters.offset(u) for u in range(len(text) + 1)] == list(range(len(text) + 1))
    assert len(fill_middle.Runs("")) == 0 and fill_middle.Runs("").offset(0) == 0


def test_fill_middle_of_an_empty_table(odd):
    assert fill_middle.transform_documents(odd.limit(0)).count() == 0


# --- op13 ------------------------------------------------------------------------
def plain_means(rows, k, rounds, size, scale=1024, seed=3):
    """rows: (id, components); every distance measured, in Python's integers."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(v) for _, v in start]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min(range(len(centres)), key=lambda j: (far(v, centres[j]), j)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centres)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    at = assign()
    return Counter((i, a, far(v, centres[a]), tuple(centres[a])) for (i, v), a in zip(kept, at, strict=True))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("extra") for c in NAMES})


@pytest.mark.parametrize("grid", [1, 16, 1024])
def test_centroids_equal_brute_force(spark, grid):
    """A coarse grid gives many equal distances and equal starting centroids."""
    rng = np.random.default_rng(grid)
    rows = [(i if i % 50 else None, [float(x) / grid for x in rng.integers(-2 * min(grid, 3), 3 * min(grid, 3), 4)]) for i in range(300)] + [(1, [0.0] * 4)] * 40
    rows += [(900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0]), (903, [math.nan, 0.0, 0.0, 0.0]), (904, [math.inf, 0.0, 0.0, 0.0]), (905, [])]
    got = elkan.cluster_vectors(vectors(spark, rows), k=6, rounds=5, size=4).collect()
    assert Counter((r.vec_id, r.cluster, r.distance, tuple(r.centroid)) for r in got) == plain_means(rows, 6, 5, 4)
    by = Counter()
    for r in got:
        by[r.cluster] += r.distance
    assert all(r.cluster_inertia == by[r.cluster] and r.inertia == sum(by.values()) for r in got)


def test_bounds_spare_distances(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(10 * (i % 6), 0.3, 4)]) for i in range(600)]
    got = elkan.cluster_vectors(vectors(spark, rows), k=6, rounds=5, size=4).collect()
    assert sum(r.measured for r in got) < 0.5 * 600 * 6 * 6
    assert Counter((r.vec_id, r.cluster, r.distance, tuple(r.centroid)) for r in got) == plain_means(rows, 6, 5, 4)


def test_centroids_of_few_and_no_vectors(spark):
    two = [(1, [0.5, 0.5]), (2, [0.25, -0.5])]
    assert sorted((r.vec_id, r.distance) for r in elkan.cluster_vectors(vectors(spark, two), k=8, rounds=2, size=2).collect()) == [(1, 0), (2, 0)]
    none = elkan.cluster_vectors(vectors(spark, two).limit(0), k=8, rounds=2, size=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "measured"]
    with pytest.raises(Exception, match="beyond"):
        elkan.cluster_vectors(vectors(spark, [(1, [1e300, 0.0])]), size=2).collect()


# --- op11 ------------------------------------------------------------------------
def lower_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))


def test_base_scores_equal_brute_force(spark, odd):
    got = gru_lm.score_documents(odd).collect()
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    counts = Counter(w for r in ODD if not held(r[0]) for w in [*lower_words(r[1] or ""), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in ODD:
        ws = [*lower_words(r[1] or ""), None]
        want.append((r[0] if r[0] is not None else -1, held(r[0]), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)))
    have = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    for a, b in zip(have, sorted(want), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert gru_lm.score_documents(odd.limit(0)).count() == 0
    untaught = gru_lm.score_documents(odd, train_where=lambda i: F.lit(False)).collect()
    assert len(untaught) == len(ODD) and all(r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in untaught)


def test_the_model_beats_the_counts_and_where_words_are_kept_changes_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = {r.doc_id: r for r in gru_lm.score_documents(docs).collect()}
    held = [r for r in one.values() if r.held_out]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held)
    for r in gru_lm.score_documents(docs, dictionary=1500).collect():
        o = one[r.doc_id]
        assert (r.n_tokens, r.n_known) == (o.n_tokens, o.n_known)
        assert abs(r.base_score - o.base_score) < 1e-6 * abs(o.base_score) and abs(r.score - o.score) < 1e-4 * abs(o.score)


def small_vocabulary():
    words = [b"w%d" % i for i in range(30)]
    return gru_lm.Vocabulary(words, [60 - i for i in range(30)], {s: (sum(60 - i for i in range(30) if words[i][-2:] == s), sum(w[-2:] == s for w in words)) for s in {w[-2:] for w in words}}, sum(range(31, 61)), 30)


def test_network_gradients_equal_differences():
    rng = np.random.default_rng(3)
    net = gru_lm.Network.fresh(small_vocabulary())
    # As found by differences, in double precision.
    for part in net.w:
        net.w[part] = net.w[part].astype(np.float64)
    x, keep = rng.integers(0, 30, (5, 3)), np.ones((5, 3))
    keep[2, 1] = 0
    y = np.where(rng.random((5, 3)) < 0.3, gru_lm.HEAD + rng.integers(0, gru_lm.RARE_CLASSES, (5, 3)), rng.integers(0, 30, (5, 3)))

    def loss():
        run = net.forward(x, keep, np.zeros((gru_lm.HIDDEN, 3), np.float32))
        return -net.outputs(gru_lm.by_token(run["states"]), y.ravel(), False)[0].sum(), run

    _, run = loss()
    _, back, grads = net.outputs(gru_lm.by_token(run["states"]), y.ravel(), True)
    d_in, d_recur = net.backward(run, back.reshape(5, 3, -1).transpose(0, 2, 1))
    d_inputs = np.zeros_like(net.w["inputs"])
    np.add.at(d_inputs, x, d_in.transpose(0, 2, 1))
    words = np.zeros_like(net.w["to_word"])
    for c, g in grads["to_word"].items():
        words[c] = g
    for name, grad in (("recur", d_recur), ("inputs", d_inputs), ("to_class", grads["to_class"]), ("to_word", words)):
        flat = np.argsort(-np.abs(grad).ravel())[:5]
        for at in flat:
            w, step = net.w[name].reshape(-1), 2e-2
            before = w[at]
            w[at] = before + step
            high = loss()[0]
            w[at] = before - step
            low = loss()[0]
            w[at] = before
            assert abs((high - low) / (2 * step) - grad.ravel()[at]) < 0.02 * max(0.5, abs(grad.ravel()[at])), name


def test_probabilities_of_the_next_word_add_up_to_one():
    voc = small_vocabulary()
    net = gru_lm.Network.fresh(voc)
    state = np.random.default_rng(1).uniform(-1, 1, (1, gru_lm.HIDDEN)).astype(np.float32)
    symbols = np.r_[np.arange(voc.size), gru_lm.HEAD + np.arange(gru_lm.RARE_CLASSES)].astype(np.int32)
    logs = net.outputs(np.repeat(state, len(symbols), axis=0), symbols, False)[0]
    assert abs(np.exp(logs).sum() - 1) < 1e-3


def test_exponentials_equal_numpys():
    x = np.linspace(-80, 80, 3 * gru_lm.AT_ONCE + 15).reshape(3, -1)
    got = gru_lm.exponentials(x.astype(np.float32))
    assert got.shape == x.shape and np.abs(got / np.exp(x.astype(np.float32).astype(np.float64)) - 1).max() < 1e-5
    assert gru_lm.exponentials(np.zeros((0, 4), np.float32)).shape == (0, 4)


def test_one_look_gives_symbols_and_places():
    words = [b"w%d" % i for i in range(gru_lm.HEAD + 5)]
    voc = gru_lm.Vocabulary(words, list(range(len(words) + 9, 9, -1)), {w[-2:]: (10**6, 10**4) for w in words}, 10**7, 10**5)
    for text in ("", "W3 w1024 w9 new w1028\tw1023", " w1029\n"):
        symbols, ws, places = voc.encode_with_places(text)
        assert symbols.tolist() == voc.encode(text)[0].tolist() and ws == [*gru_lm.tokens(text), gru_lm.END]
        assert places.tolist() == [voc.place.get(w, -1) for w in ws]
        assert symbols.tolist() == [p if 0 <= p < gru_lm.HEAD else gru_lm.HEAD + voc.rare_class(w) for p, w in zip(places, ws)]


def test_a_step_adds_up_the_gradients_of_a_symbol(monkeypatch):
    rng, net = np.random.default_rng(7), gru_lm.Network.fresh(small_vocabulary())
    x, y, valid = rng.integers(0, 6, (4, 3)), rng.integers(0, 30, (4, 3)), np.ones((4, 3), bool)
    valid[2:, 2] = False
    run, steps, found = net.forward(x, np.ones((4, 3), np.float32), np.zeros((gru_lm.HIDDEN, 3), np.float32)), {}, []
    monkeypatch.setattr(net, "step", lambda name, grad, rows=None: steps.setdefault(name, (grad, rows)))
    monkeypatch.setattr(net, "backward", lambda *a: found.append(gru_lm.Network.backward(net, *a)) or found[-1])
    net.learn(run, y, valid)
    plain = np.zeros((6, 3 * gru_lm.HIDDEN))
    np.add.at(plain, x[valid], found[0][0].transpose(0, 2, 1)[valid])
    grad, rows = steps["inputs"]
    assert rows.tolist() == sorted(set(x[valid].tolist()))
    assert np.allclose(grad / np.abs(grad).max(), plain[rows] / np.abs(plain[rows]).max(), atol=1e-5)


def test_scores_do_not_depend_on_the_company():
    voc, rng = small_vocabulary(), np.random.default_rng(5)
    net = gru_lm.Network.fresh(voc)
    texts = [rng.integers(0, 30, n).astype(np.int32) for n in (1, 5, 700, 33, 2, 16, 17)]
    gru_lm.learn_texts(net, texts)
    together = gru_lm.score_texts(net, texts)
    assert np.allclose(together, [gru_lm.score_texts(net, [t])[0] for t in texts], rtol=1e-5)
    assert len(gru_lm.score_texts(net, [])) == 0


def test_queries_give_the_contract_columns(spark, sf_dir):
    assert queries.op11_recurrent_lm(spark, sf_dir).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = queries.op12_fill_middle(spark, sf_dir)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r.restored_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows.collect())


def test_evidence_has_no_ceiling_and_no_overflow():
    from tessera.llm import toxicity

    plain = lambda r: math.log(sum(math.exp(v - statistics.median([*r, *[0.0] * toxicity.CENTRE])) for v in r) / len(r))
    for r in ([1.0, -2.0, 0.5], [30.0] + [0.1] * 20, [13.0, 12.0, -40.0, 0.0]):
        assert abs(toxicity.evidence(np.array(r)) - plain(r)) < 1e-9
    assert toxicity.evidence(np.array([5000.0, 0.0, 0.0])) > toxicity.evidence(np.array([900.0, 0.0, 0.0])) > toxicity.evidence(np.array([14.0, 0.0, 0.0])) > toxicity.evidence(np.array([12.0, 0.0, 0.0]))
