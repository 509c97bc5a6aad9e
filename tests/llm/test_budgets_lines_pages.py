"""Budgets with weights of zero, lines by place, pages without a main element."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import html_main, line_dedup, mixing


def plain_share(budget, caps, weights):
    """Fill children by weight again and again until nothing moves."""
    got = [0.0] * len(caps)
    for _ in range(200):
        rest = budget - sum(got)
        room = [i for i in range(len(caps)) if weights[i] > 0 and got[i] < caps[i] - 1e-9]
        if rest <= 1e-9 or not room:
            break
        total = sum(weights[i] for i in room)
        for i in room:
            got[i] = min(caps[i], got[i] + rest * weights[i] / total)
    return got


def plain_budgets(leaves, share):
    """leaves: (dom, lng, src, tokens, w_dom, w_lng, w_src), one epoch."""
    def cap(rows, level):
        if level == 3:
            return rows[0][3] if rows[0][6] > 0 else 0
        groups = {}
        for r in rows:
            groups.setdefault(r[level], []).append(r)
        return sum(cap(g, level + 1) if level == 2 or g[0][4 + level] > 0 else 0 for g in groups.values())

    def walk(rows, level, budget):
        if level == 3:
            return {rows[0][:3]: budget}
        groups = {}
        for r in rows:
            groups.setdefault(r[level], []).append(r)
        keys = sorted(groups)
        caps = [cap(groups[k], level + 1) for k in keys]
        out = {}
        for k, b in zip(keys, plain_share(budget, caps, [groups[k][0][4 + level] for k in keys]), strict=True):
            out |= walk(groups[k], level + 1, b)
        return out

    return walk(leaves, 0, int(sum(r[3] for r in leaves) * share))


def test_budgets_equal_a_recursive_filler_with_zero_weights(spark):
    probe = [("d", "en", "A1", 500, 1, 1, 1), ("d", "en", "A2", 2000, 1, 1, 0), ("d", "de", "B1", 2000, 1, 1, 1)]
    rng = random.Random(6)
    wide = []
    for d in range(4):
        wd = rng.choice([0, 1, 2, 3])
        for n in range(3):
            wl = rng.choice([0, 1, 2])
            wide += [(f"d{d}", f"l{n}", f"s{s}", rng.randint(0, 900), wd, wl, rng.choice([0, 0, 1, 4])) for s in range(4)]
    for leaves, share in ((probe, 0.5), (wide, 0.2), (wide, 0.6), (wide, 1.0)):
        df = spark.createDataFrame(leaves, "dom string, lng string, src string, tokens long, w_dom long, w_lng long, w_src long")
        got = {(r.dom, r.lng, r.src): r.b_src for r in mixing.budgets(df, share, 1).collect()}
        want = plain_budgets(leaves, share)
        assert all(abs(got[k] - want[k]) < 1e-3 for k in want), share
    df = spark.createDataFrame(probe, "dom string, lng string, src string, tokens long, w_dom long, w_lng long, w_src long")
    assert {r.src: round(r.b_src) for r in mixing.budgets(df, 0.5, 1).collect()} == {"A1": 500, "A2": 0, "B1": 1750}


@pytest.mark.parametrize("page", [
    '<html><body><form id="aspnetForm"><div><p>The whole story is here.</p></div></form></body></html>',
    '<html><body><div class="market-share-report"><p>The whole story is here.</p></div></body></html>',
    '<html><body><div class="post-content social-policy"><p>The whole story is here.</p></div></body></html>',
])
def test_a_page_is_not_lost_to_a_form_or_a_class(page):
    assert html_main.main_text(html_main.parse(page))[0] == "The whole story is here."


def test_small_forms_and_cues_still_go():
    page = "<body><div><p>A long story that goes on and on and on.</p></div><form><p>Subscribe</p></form><div class='social-links'><p>Follow</p></div></body>"
    assert html_main.main_text(html_main.parse(page))[0] == "A long story that goes on and on and on."


def plain_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            n[k] = n.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n.get(key(x), 0) < least]
        out.append((-1 if i is None else i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_lines_of_null_and_repeated_ids(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, i]), "\n".join(rng.choice(["a", " A ", "b", "", f"own {i}", f"pair {i // 2}", "c"]) for _ in range(rng.randint(0, 9)))) for i in range(150)]
    rows += [(7, "b\nb\nx"), (7, "b\nb\nx"), (None, None)]
    got = line_dedup.drop_frequent_lines(spark.createDataFrame(rows, "doc_id long, text string"), 3)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == plain_lines(rows, 3)


def test_many_frequent_lines_cost_in_proportion(spark):
    def took(n):
        df = spark.range(10).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n").alias("text"))
        began = time.time()
        assert line_dedup.drop_frequent_lines(df, 10).agg(F.sum("n_dropped")).first()[0] == 10 * n
        return time.time() - began

    took(100)
    assert took(16_000) < 4 * took(4_000) + 5


def test_a_failing_batch_leaves_no_runs(spark, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}
    add = line_dedup.LineRuns.add

    def fails(self, hashes):
        if self._made:
            raise ValueError("lost")
        add(self, hashes)

    monkeypatch.setattr(line_dedup.LineRuns, "add", fails)
    with pytest.raises(ValueError, match="lost"):
        line_dedup.drop_frequent_lines(spark.createDataFrame([(i, "x") for i in range(20)], "doc_id long, text string"), 3)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_shapes_hold_every_name_in_any_order():
    names = [f"c{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)]

    def shape(kinds):
        page = html_main.parse("<body><div class='box'>" + "".join(f"<div class='{k}'>x <b>y</b></div>" for k in kinds) + "</div><p>" + "text " * 500 + "</p></body>")
        return html_main.subtree_hashes(page)[page.kind.index("box")][1]

    assert shape(names) == shape(names[::-1]) == shape(names + names[:7]) is not None
    assert len({shape(names[:i] + names[i + 1 :]) for i in range(100)} | {shape(names)}) == 101


def test_shape_sets_equal_a_plain_union():
    rng = random.Random(5)
    html = "<body>"
    open_ = 0
    for _ in range(3000):
        if open_ and rng.random() < 0.5:
            html, open_ = html + "</div>", open_ - 1
        else:
            html, open_ = html + f"<div class='k{rng.choice('abcdefgh')}'>t", open_ + 1
    page = html_main.parse(html)
    sets = [set() for _ in page.tag]
    path = [""] * len(sets)
    for e in range(len(sets) - 1, 0, -1):
        sets[page.parent[e]] |= sets[e] | {f"{page.tag[e]}.{page.kind[e]}"}
    for e in range(1, len(sets)):
        path[e] = f"{path[page.parent[e]]}/{page.tag[e]}.{page.kind[e]}"
    by_shape, by_set = {}, {}
    for e, (_, shape, _, _) in enumerate(html_main.subtree_hashes(page)):
        if shape is not None:
            by_shape.setdefault(shape, set()).add(e)
            by_set.setdefault((path[e], frozenset(sets[e])), set()).add(e)
    assert len(by_set) > 50 and sorted(map(sorted, by_shape.values())) == sorted(map(sorted, by_set.values()))
