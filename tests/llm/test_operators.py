"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, exact_dedup, html_main, imatch, line_dedup, mixing, pii, piece_bpe, queries, simhash, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null ids and texts, empty and very long texts, ties and repeated rows.
ODD = [
    (1, "The cat sat on the mat.\nShared line\nEnd", "en", "src0", 40),
    (2, None, None, None, None),
    (3, "", "en", "src1", 0),
    (4, "The cat sat on the mat.\nShared line\nEnd", "en", "src0", 40),
    (4, "The cat sat on the mat.\nShared line\nEnd", "en", "src0", 40),
    (5, "word " * 30_000 + "end", "de", "src9", 150_003),
    (6, "x" * 20_000, "xx", "other", 20_000),
    (None, "null id " * 5, "en", "src0", 40),
    (7, " \t\n ", "fr", "src15", 4),
    (8, "naïve 日本語 😀 text▁mark \x00 nul", "fr", "src15", 30),
]


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows with columns whose names clash with those the operators use."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({c: F.lit("extra") for c in ("id", "label", "component", "score", "copies", "node", "key", "dom", "tokens", "hot", "body", "bucket", "found")})


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def empty(df):
    return df.limit(0)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- op1 -----------------------------------------------------------------------
def test_imatch_edits_and_order(spark, sf_dir, texts):
    got = {r.doc_id: r for r in queries.op1_imatch(spark, sf_dir).collect()}
    ids = sorted(texts)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[a], len(texts[a])
        assert got[a].n_chars == n and got[a].edited_sha256 == sha(t[: n - n // 2] + texts[b][: n // 2])
    by_text = {}
    for i, t in texts.items():
        by_text.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    near, far = [r.near_edited for r in got.values()], [r.near_next for r in got.values()]
    assert all(0 <= x <= 1 for x in near + far) and sum(a > b for a, b in zip(near, far)) > 0.85 * len(near)


def test_imatch_odd_rows(odd):
    got = imatch.fingerprint_documents(odd).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((r[0] is not None, r[0] or 0) for r in ODD)
    assert len({r.fingerprint for r in got if r.doc_id in (1, 4)}) == 1
    assert imatch.fingerprint_documents(empty(odd)).count() == 0


def plain_fingerprint_of(text, lexicon):
    """The fingerprint by its definition: Python integers, one subset after another."""
    m64 = 2**64 - 1

    def mix(x, seed):
        x ^= seed * 0x9E3779B97F4A7C15 & m64
        x = (x ^ x >> 31) * 0x7FB5D329728EA185 & m64
        x = (x ^ x >> 27) * 0x81DADEF4BC2DD44D & m64
        return x ^ x >> 33

    terms = sorted({xxhash.xxh64_intdigest(w.encode()) for w in text.lower().split()})
    terms = [t for t in terms if t in lexicon] or terms
    take = [(terms, 0)]
    for level in imatch.LEVELS:
        fields = 64 // level
        for s in range(imatch.PER_LEVEL):
            bits = [mix(t, 100 * level + s - s % fields) >> level * (s % fields) for t in terms]
            take.append(([t for t, b in zip(terms, bits) if b % 2**level == 0], len(take)))
    out = []
    for own, column in take:
        total = mix(sum(mix((t + i * 0x9E3779B97F4A7C15) & m64, 7) for i, t in enumerate(own)) & m64, column)
        out.append(0 if not own else total % 65535 + 1 if column else total | 1)
    return f"{out[0]:016x}" + "".join(f"{x:04x}" for x in out[1:])


def test_imatch_equals_brute_force_both_ways(docs, texts, odd):
    n = {}
    for t in texts.values():
        for w in set(t.lower().split()):
            n[w] = n.get(w, 0) + 1
    idf = lambda w: (np.log(len(texts)) - np.log(n[w])) / np.log(len(texts))
    words = {w for w in n if imatch.MIN_IDF <= idf(w) <= imatch.MAX_IDF}
    assert 0 < len(words) < 0.9 * len(n)
    lexicon = {xxhash.xxh64_intdigest(w.encode()) for w in words}
    got = {r.doc_id: r for r in imatch.fingerprint_documents(docs).collect()}
    assert all(got[i].fingerprint == plain_fingerprint_of(t, lexicon) and got[i].edited_fingerprint == plain_fingerprint_of(got[i].edited_text, lexicon) for i, t in texts.items())
    for df in (docs, odd):
        a, b = (sorted(map(str, imatch.fingerprint_documents(df, broadcast_terms=k).collect())) for k in (1 << 20, 0))
        assert a == b


def test_imatch_of_a_large_lexicon_writes_and_moves_no_more_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeÉΣ", k=rng.randint(1, 9))) for _ in range(4_000)]
    rows = [(i, rng.choice([" ", "\n"]).join(rng.choices(words, k=rng.randint(0, 400))), None, None, None) for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    want = sorted(map(str, imatch.fingerprint_documents(df).collect()))
    folder = re.sub("^file:", "", spark.conf.get("spark.checkpoint.dir").replace("//", ""))
    held = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names)
    for most in (0, 50, 3_000):
        before = held()
        out = imatch.fingerprint_documents(df, broadcast_terms=most)
        assert sorted(map(str, out.collect())) == want
        assert most < 3_000 or held() - before < 0.25 * sum(len(r[1].encode()) for r in rows)  # once all terms and edited texts were written
        assert out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_imatch_seams_hold_all_new_words():
    rng = random.Random(6)
    for _ in range(3_000):
        a, b = ("".join(rng.choices("abΣÉ' \t\u2028", k=rng.randint(0, 12))) for _ in range(2))
        x, y = a[: len(a) - len(a) // 2], b[: len(a) // 2]
        assert set((x + y).lower().split()) <= {w for t in (a, b, imatch.seams(x, y)) for w in t.lower().split()}


def test_imatch_likeness_bounds():
    a = imatch.fingerprints(["alpha beta gamma delta", "alpha beta gamma delta", "", "other words here"], np.zeros(0, np.uint64))
    assert imatch.likeness(a[:1], a[1:2])[0] == 1 and imatch.likeness(a[2:3], a[2:3])[0] == 1 and imatch.likeness(a[:1], a[2:3])[0] == 0 and imatch.likeness(a[:1], a[3:4])[0] == 0


# --- op2 -----------------------------------------------------------------------
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+".replace("\\x20-", " -"))
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_pii_base_spans_equal_the_patterns():
    rng = random.Random(1)
    parts = ["1", "2", "9", "0", "255", ".", "..", "@", "a", "b.c", "+", "+1", " ", "-", "(", ")", "é", "4111111111111111", "1.2.3.4", "x@y.z", "\n", "%"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert [s for s in pii.spans(t) if s[0] in pii.BASE_KINDS] == base_spans(t), t


def test_pii_added_kinds_and_query(spark, sf_dir, texts, odd):
    t = "see https://a.example.org/x?y=1, IBAN: DE89370400440532013000 and account number 12345678; token = \"0123456789abcdef01\""
    assert [(k, t[a:b]) for k, a, b in pii.spans(t) if k in pii.MORE_KINDS] == [("url", "https://a.example.org/x?y=1"), ("account", "DE89370400440532013000"), ("account", "12345678"), ("secret", "0123456789abcdef01")]
    assert pii.spans("0" * 5000 + ".1.1.1") and not pii.spans("")
    for r in queries.op2_personal_data(spark, sf_dir).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in want)) and r.n_email == sum(k == "email" for k, _, _ in want)
    assert pii.find_personal_data(odd, to="spans").count() == len(ODD) and pii.find_personal_data(empty(odd)).count() == 0


@pytest.mark.parametrize("tail", ["", " BIC COBADEFF", " AND", ".", " and more"])
@pytest.mark.parametrize("number", ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "de89370400440532013000", "GB82 WEST 1234 5698 7654 32"])
def test_account_numbers_end_where_their_country_says(number, tail):
    t = f"IBAN {number}{tail}"
    assert [t[a:b] for k, a, b in pii.spans(t) if k == "account"] == [number]
    assert not [s for s in pii.spans(f"IBAN {number}0{tail}") if s[0] == "account"] and not [s for s in pii.spans(t.replace("8", "7", 1)) if s[0] == "account"]


def test_a_million_anchors_take_seconds():
    for unit in ("@", "1.", "1 ", "+1", "://", "IBAN DE", "token=", "a@b."):
        began = time.monotonic()
        pii.spans(unit * (1_000_000 // len(unit)))
        assert time.monotonic() - began < 20, unit


# --- op3 -----------------------------------------------------------------------
def test_water_filling():
    def fill(budget, kids):  # plain reference: (cap, weight)
        got, open_ = [0.0] * len(kids), {i for i, (c, w) in enumerate(kids) if w > 0}
        while open_ and budget > 1e-9:
            total = sum(kids[i][1] for i in open_)
            full = {i for i in open_ if kids[i][0] - got[i] <= budget * kids[i][1] / total + 1e-12}
            if not full:
                for i in open_:
                    got[i] += budget * kids[i][1] / total
                break
            for i in full:
                budget -= kids[i][0] - got[i]
                got[i] = kids[i][0]
            open_ -= full
        return got

    assert fill(10, [(2, 1), (100, 1)]) == [2, 8]
    test_water_filling.fill = fill


def test_budgets_against_plain_filling(spark):
    test_water_filling()
    rng, rows = random.Random(5), []
    for dom in "abc":
        for lng in "xy":
            for src in "123":
                rows.append((dom, lng, src, rng.randrange(0, 1000), {"a": 5.0, "b": 3.0, "c": 0.0}[dom], {"x": 2.0, "y": 1.0}[lng], float(src)))
    leaves = spark.createDataFrame(rows, "dom string, lng string, src string, tokens long, w_dom double, w_lng double, w_src double")
    got = {(r.dom, r.lng, r.src): r.b_src for r in mixing.budgets(leaves, 0.9, 1).collect()}
    total, fill = sum(r[3] for r in rows) * 9 // 10, test_water_filling.fill
    cap = lambda *p: sum(r[3] for r in rows if r[: len(p)] == p)
    for dom, b in zip("abc", fill(total, [(cap(x), w) for x, w in zip("abc", (5, 3, 0))])):
        for lng, b2 in zip("xy", fill(b, [(cap(dom, y), w) for y, w in zip("xy", (2, 1))])):
            for src, b3 in zip("123", fill(b2, [(cap(dom, lng, z), int(z)) for z in "123"])):
                assert abs(got[dom, lng, src] - b3) < 1e-6


def test_mixture_prefix_and_odd_rows(spark, odd, docs):
    domain, weights = queries.mix_tree()
    got = mixing.mix_report(odd, domain, weights, 0.5, 2, 1)
    assert got.count() == len(ODD) and got.agg(F.max("copies")).first()[0] <= 2
    assert mixing.mix_report(empty(odd), domain, weights, 0.5, 2, 1).count() == 0
    kept = mixing.mix_documents(odd, domain, weights, 1.0, 1, 1)
    assert kept.columns == odd.columns and kept.count() <= len(ODD)
    report = mixing.mix_report(docs, domain, weights, 0.6, 2, 17)
    used, total = report.agg(F.sum(F.col("copies") * F.col("n_tokens")), F.sum("n_tokens")).first()
    assert used <= 0.6 * total and used > 0.4 * total


# --- op4 -----------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_file())


def test_pieces_equal_the_library(library):
    with open(queries.piece_model_file(), "rb") as f:
        model = piece_bpe.PieceModel(f.read())
    encoder, rng = piece_bpe.Encoder(model), random.Random(3)
    parts = ["a", "b", "Sc", "the ", " ", "  ", "▁", "\n", "é", "日", "😀", "𝟘", "|", "||", "==", "    ", "ing", "\t", "\0", "<s>", "aaaa", "00", "ß"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)]
    pieces = [p.replace("▁", " ") for p in model.pieces[300:]]
    rows += ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(3000)]
    rows += ["a" * 5000, " " * 3000, "x y" * 3000, "Sc" * 2000, ""]
    flat, bounds = encoder.encode(rows)
    for i, t in enumerate(rows):
        ids = flat[bounds[i] : bounds[i + 1]]
        assert ids.tolist() == library.encode(t), t
        assert model.decode(ids) == library.decode(ids.tolist())
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(0, model.size)]) for _ in range(12)]
        assert model.decode(np.array(ids)) == library.decode(ids)


@pytest.mark.parametrize("unit", [" ", "x" + " " * 99, "th", "ACGTTGCA", "\n", "▁and"])
def test_a_million_characters_take_seconds(library, unit):
    with open(queries.piece_model_file(), "rb") as f:
        encoder = piece_bpe.Encoder(piece_bpe.PieceModel(f.read()))
    text, began = unit * (1_000_000 // len(unit)), time.monotonic()
    ids, _ = encoder.encode([text])
    assert time.monotonic() - began < 30 and ids.tolist() == library.encode(text)


def test_long_segments_go_through_the_queue(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "LONG", 3)
    with open(queries.piece_model_file(), "rb") as f:
        encoder = piece_bpe.Encoder(piece_bpe.PieceModel(f.read()))
    rng = random.Random(6)
    rows = ["".join(rng.choice(("th", "and", "e", "in", "▁", " ", "ing", "==", "a", "日", "   ")) for _ in range(rng.randrange(40))) for _ in range(2000)]
    flat, bounds = encoder.encode(rows)
    assert all(flat[bounds[i] : bounds[i + 1]].tolist() == library.encode(t) for i, t in enumerate(rows))


def test_encode_query_and_odd_rows(spark, sf_dir, texts, odd, library):
    for r in queries.op4_sentencepiece(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    got = piece_bpe.encode_documents(odd, queries.piece_model_file()).collect()
    assert sorted(map(str, (r.ids for r in got))) == sorted(str(library.encode(r[1] or "")) for r in ODD)
    assert piece_bpe.encode_documents(empty(odd), queries.piece_model_file()).count() == 0


# --- op5 -----------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>menu</a></ul></nav>
<header>top</header><div class="cookie-notice">cookies</div><article><h1>Head &amp; line</h1><p>One<br>two <b>bold</b> &lt;x&gt;<p>Three&nbsp; four<!-- c --><div class="ad">buy</div>
<table><tr><td>c1<td>c2</table><form><input value=1>f</form><section id="comments">first!</section></article><aside>side</aside><footer>&copy; x</footer>"""


def plain_main(page):
    return html_main.main_text(page)[0]


def test_main_text():
    assert plain_main(html_main.parse(PAGE)) == "Head & line\n\nOne two bold <x>\n\nThree four\n\nc1\n\nc2"
    assert plain_main(html_main.parse("")) == "" and plain_main(html_main.parse("plain")) == "plain"
    assert plain_main(html_main.parse("<p>a<p>b</i>c<nav>x</nav>d")) == "a\n\nbc\n\nd"
    assert plain_main(html_main.parse("<div>" * 2000 + "deep")) == "deep"
    assert plain_main(html_main.parse("<script>never closed")) == "" and plain_main(html_main.parse("a < b <")) == "a < b <"


def test_site_templates_go_and_copies_stay(spark):
    box = "<div>Follow the site</div>"
    rows = [(i, "http://a.example/x", f"<body>{box}<p>own text {i}</p></body>") for i in range(10)] + [(100 + i, "http://b.example/", "<body><div>the same page</div></body>") for i in range(20)]
    rows += [(200, None, None), (201, "http://a.example/y", ""), (202, "http://c.example/", f"<body>{box}</body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("extra"), "hashes": F.lit(1)})
    got = {r.page_id: r.text for r in html_main.extract_pages(pages).collect()}
    assert got[3] == "own text 3" and got[105] == "the same page" and got[200] == "" and got[201] == "" and got[202] == "Follow the site"
    assert html_main.extract_pages(empty(pages)).count() == 0


def test_shapes_of_templates_go_without_any_names(spark, sf_dir, monkeypatch):
    """Pages of the data without article and cue words: shapes alone find the text."""
    pages = [r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()][:60]
    rows = [(r.page_id, f"http://site{i % 3}.example/{i}", r.html) for i, r in enumerate(pages)]
    want = {i: plain_main(html_main.parse(h)) for i, _, h in rows}
    bare = [(i, u, h.replace("<article>", "<div class=x>").replace("</article>", "</div>").replace("<nav>", "<div class=y>").replace("</nav>", "</div>").replace("<footer>", "<div class=z>").replace("</footer>", "</div>").replace('class="ad"', "class=w")) for i, u, h in rows]
    got = {r.page_id: r for r in html_main.extract_pages(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    assert sum(got[i].text == want[i] for i in want) > 0.95 * len(want) and all(r.n_template >= 2 and r.n_named <= 1 for r in got.values())
    assert sum(plain_main(html_main.parse(h)) != want[i] for i, _, h in bare) > 0.9 * len(want)


@pytest.mark.parametrize("page, text", [
    ('<body class="no-sidebar"><p>a</p></body>', "a"), ('<div id="page" class="has-comments"><h1>h</h1><p>a</p></div>', "h\n\na"), ('<article class="post sharing"><p>a</p></article>', "a"),
    ('<article><p>a</p></article><section id="comments"><article class="comment"><p>c</p></article></section>', "a"), ("<p>a</p><svg><p>b</p>", "a\n\nb"), ("<form id=f><main><p>a</p></main></form>", "a"),
    ("<p title=\"x>a</p>", "a"), ("<div>" * 5000 + "<nav>m</nav>deep", "deep"),
])
def test_names_never_drop_the_main_part(page, text):
    assert plain_main(html_main.parse(page)) == text


@pytest.mark.parametrize("unit", ["<a ", "<p", "<b>", "<div><p>", "<svg>", "</p>", "<!--", "<a '\"", "<li>", "<div>x", "<table><tr><td>"])
def test_a_million_tags_take_seconds(unit):
    began = time.monotonic()
    page = html_main.parse(unit * (1_000_000 // len(unit)) + '"')
    html_main.main_text(page, {1})
    assert time.monotonic() - began < 40


def test_pages_keep_their_documents(spark, sf_dir, texts):
    whole = {" ".join(t.split()) for t in texts.values()}
    got = queries.op5_main_text(spark, sf_dir).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    assert sum(" ".join(r.text.split("\n\n")[1:]) in whole for r in got) > 0.99 * len(got)


# --- op6 -----------------------------------------------------------------------
def test_url_rules(spark):
    urls = {
        1: "https://WWW.x.example.com/en/8", 2: "http://x.example.com/en/71?a=1", 3: "http://x.example.net/de/1", 4: "http://example.net/de/8#f", 5: "http://a.org/es/", 6: "http://a.org/fr/", 7: None, 8: "no scheme",
        9: "http://notexample.net/de/8", 10: "http://casino-win.example.org/x", 11: "http://a.com?x=1",
    }
    pages = spark.createDataFrame([(k, u) for k, u in urls.items()] + [(100 + i, f"http://free-bets.example.org/{i}") for i in range(20)] + [(200 + i, f"http://good{i}.example.org/{i}") for i in range(20)], "page_id long, url string").withColumn("label", F.lit("extra"))
    got = {r.page_id: r for r in url_filter.judge(pages, queries.URL_RULES, queries.url_labels(pages)).collect()}
    rules = {k: got[k].rule for k in urls}
    assert rules == {1: "com/en/", 2: "example.com/en/7", 3: "net/de/", 4: "example.net/de/8", 5: "org/es/", 6: None, 7: None, 8: None, 9: "net/de/", 10: None, 11: None}
    assert got[1].verdict == "block" and got[2].verdict == "allow" and got[4].verdict == "block" and got[3].verdict == "allow"
    assert (got[1].host, got[1].path, got[11].host, got[11].path, got[7].host, got[8].path) == ("www.x.example.com", "/en/8", "a.com", "", "", "")
    assert got[105].verdict == "block" and got[205].verdict == "allow"
    left = url_filter.filter_pages(pages, queries.URL_RULES, queries.url_labels(pages))
    assert left.columns == pages.columns and 105 not in {r.page_id for r in left.collect()}
    assert url_filter.judge(empty(pages), queries.URL_RULES, queries.url_labels(empty(pages))).count() == 0


def test_url_features_by_hand():
    got = dict(zip(url_filter.FEATURES, url_filter.lexical("https://a1.b-c.example.org/x/y2/?q=1&r=22#t", "a1.b-c.example.org", "/x/y2/"), strict=True))
    want = {"length": 43, "host_length": 18, "path_length": 6, "host_labels": 4, "depth": 2, "host_digits": 1 / 18, "hyphens": 1, "parameters": 2, "query_length": 8, "fragment": 1, "secure": 1, "longest_word": 7, "host_vowels": 0}
    assert {k: got[k] for k in want} == want and abs(got["digits"] - 5 / 43) < 1e-12 and abs(url_filter.entropy("aabb") - 1) < 1e-12


def test_suffix_rates_leave_the_own_fold_out(spark):
    rows = [(i, f"http://h{i}.{'bad' if i % 2 else 'good'}.org/{i}", float(i % 2)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label double")
    with url_filter.Scratch(spark) as scratch:
        got = url_filter._prepared(pages, pages, "page_id", "url", scratch).collect()
    for r in got:
        others = [x for x in got if x.suffix == r.suffix and x.fold != r.fold]
        assert abs(r.rate - (sum(x.label for x in others) + 1) / (len(others) + 2)) < 1e-12


def test_trees_know_bad_hosts_that_they_have_not_seen(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    rows = url_filter.held_out(pages, queries.url_labels(pages)).collect()
    bad, good = [r.score for r in rows if r.label], [r.score for r in rows if not r.label]
    assert bad and good and np.mean([(x > y) + 0.5 * (x == y) for x in bad for y in good]) > 0.8


# --- op7 -----------------------------------------------------------------------
def test_toxicity_on_held_out_rows(spark, sf_dir):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.op7_toxicity(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    a, b = [r.score for r in got if labels.get(r.doc_id) == 1], [r.score for r in got if labels.get(r.doc_id) == 0]
    assert np.mean([x > y for x in a for y in b]) > 0.85


def test_toxicity_odd_rows(spark, odd, docs):
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (5, 0), (6, None), (None, 1), (4, 0), (7, 1), (8, 7)], "doc_id long, toxic int")
    assert toxicity.score_documents(odd, labels).count() == len(ODD)
    none = toxicity.score_documents(odd, empty(labels)).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity.score_documents(empty(odd), labels).count() == 0
    kept = toxicity.drop_toxic(odd, empty(labels))
    assert kept.columns == odd.columns and kept.count() == len(ODD)


def test_gram_counts_and_probabilities(spark):
    train = spark.createDataFrame([(1, 0, "ab ab"), (0, 3, "ab c")], "toxic int, fold int, text string")
    grams = {r.gram: r for r in toxicity.count_grams(train).collect()}
    pad = toxicity.START * (toxicity.ORDER - 1)
    r = grams[pad + "a"]
    assert (r.t, r.o, r.t3, r.o3) == (2, 1, 0, 1) and len(grams) == 5
    shared = toxicity._shared(toxicity.count_grams(train)).collect()
    assert all(0 < r.p <= 1 for r in shared)
    by = {}
    for r in shared:
        by.setdefault(r.tail[:-1], []).append(r.p)
    assert all(sum(v) <= 1 + 1e-9 for v in by.values())


def plain_ratio(gram, counts):
    """Kneser-Ney by its definition, on dictionaries: log-likelihood ratio of a
    gram and of its context's unseen grams.  counts: gram to (toxic, ordinary)."""
    d, n = toxicity.DISCOUNT, toxicity.ORDER
    types = {n: set(counts)}
    for k in range(n - 1, 0, -1):
        types[k] = {g[1:] for g in types[k + 1]}
    extends = {k: {g: sum(x[1:] == g for x in types[k + 1]) for g in types[k]} for k in range(1, n)}

    def low(g):
        n1 = extends[len(g)]
        if len(g) == 1:
            return n1[g] / sum(n1.values())
        own = {x: v for x, v in n1.items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        return max(own.get(g, 0) - d, 0) / total + d * len(own) / total * low(g[1:])

    own = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
    total = sum(map(sum, own.values()))
    q = max(sum(counts[gram]) - d, 0) / total + d * len(own) / total * low(gram[1:])
    whole, open_ = [], []
    for c in (0, 1):
        size, kinds = sum(v[c] for v in own.values()), sum(v[c] > 0 for v in own.values())
        whole.append((max(counts[gram][c] - d, 0) + (toxicity.STRENGTH + d * kinds) * q) / (size + toxicity.STRENGTH))
        open_.append((toxicity.STRENGTH + d * kinds) / (size + toxicity.STRENGTH))
    return np.log(whole[0] / whole[1]), np.log(open_[0] / open_[1])


def test_ratios_equal_plain_kneser_ney(spark):
    rng, rows = random.Random(4), []
    for i in range(30):
        rows.append((i % 2, i % 3, " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(8))))
    counts = {}
    for toxic, _, text in rows:
        for w in text.split():
            p = toxicity.START * (toxicity.ORDER - 1) + w + toxicity.END
            for j in range(len(w) + 1):
                counts.setdefault(p[j : j + toxicity.ORDER], [0, 0])[1 - toxic] += 1
    got = toxicity.gram_ratios(toxicity.count_grams(spark.createDataFrame(rows, "toxic int, fold int, text string"))).collect()
    assert len(got) == len(counts)
    for r in got:
        assert np.allclose((r["all"], r["all_c"]), plain_ratio(r.gram, counts))


def test_both_ways_give_the_same_scores(docs, spark, sf_dir, odd):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scorer = toxicity.train(docs, labels)
    for rows in (docs, odd):
        a = {(r.doc_id, r.text): r.s for r in scorer.with_score(rows.drop("score"), "s").collect()}
        b = {(r.doc_id, r.text): r.s for r in toxicity.Scorer(scorer.ratios, scorer.curve, 0).with_score(rows.drop("score"), "s").collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    empty_text = scorer.with_evidence(spark.createDataFrame([("",), (" .",)], "text string"), "e").collect()
    assert {r.e for r in empty_text} == {0.0}


# --- op8 -----------------------------------------------------------------------
def plain_fingerprint(t, width=3):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    s = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius):
    ids, root = list(fps), {i: i for i in fps}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_query(spark, sf_dir, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(fps, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in texts}


def test_simhash_components_on_dense_groups(spark):
    rng, fps = random.Random(2), {}
    for c in range(4):
        centre = rng.getrandbits(64)
        for i in range(60):
            x = centre
            for b in rng.sample(range(64), rng.randrange(0, 6)):
                x ^= 1 << b
            fps[1000 * c + i] = x
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(i, signed(f)) for i, f in fps.items()], "id long, f0 long")
    got = {r.id: r.component for r in simhash.labelled(rows, ["f0"], 2, 3, 1).collect()}
    assert got == plain_components(fps, 3)


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(edges).collect()
    assert len(got) == 200 and {r.label for r in got} == {0}
    assert components.components(edges.limit(0)).count() == 0


def test_simhash_odd_rows(odd):
    got = simhash.near_groups(odd).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (2, 3, 7)} == {2} and {r.fingerprint for r in got if r.doc_id in (2, 3, 7)} == {"0" * 16}
    assert simhash.near_groups(empty(odd)).count() == 0


def test_simhash_null_and_repeated_ids(spark):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    lone, repeated, shared = [text() for _ in range(6)], [text() for _ in range(6)], text()
    docs = spark.createDataFrame([(None, t) for t in lone] + [(7, t) for t in repeated] + [(None, shared), (9, shared), (8, shared)], "doc_id long, text string")
    got = simhash.near_groups(docs).collect()
    assert len({r.fingerprint for r in got}) == 13
    of = {f"{plain_fingerprint(t):016x}": t for t in [*lone, *repeated, shared]}
    assert all(r.component_id == (None if of[r.fingerprint] in lone else 7 if of[r.fingerprint] in repeated else 8) for r in got)
    kept = sorted(((r.doc_id, r.text) for r in simhash.drop_near_copies(docs).collect()), key=str)
    assert kept == sorted([(None, t) for t in [*lone, shared]] + [(7, t) for t in repeated], key=str)


def test_near_copies_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(12):
        base = [word() for _ in range(300)]
        rows.append((10 * g, " ".join(base)))
        near = list(base)
        near[150] = "changed"
        rows.append((10 * g + 1, " ".join(near)))
        rows.append((10 * g + 2, " ".join(base[:150] + [word() for _ in range(150)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit("extra"))
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(x for g in range(12) for x in (10 * g, 10 * g + 2))


def test_near_copies_equal_brute_force_around_the_similarity(spark):
    rng, texts = random.Random(11), []
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(40)]  # in many texts, makes none alike
    for g in range(60):
        base = [word() for _ in range(rng.choice((10, 40, 120, 300)))]
        base = base + passage if g % 3 == 0 else base
        texts.append(" ".join(base))
        for _ in range(3):
            near = list(base)
            for i in rng.sample(range(len(near)), max(1, round(len(near) * rng.uniform(0.01, 0.05)))):
                near[i] = word()
            texts.append(" ".join(near))
        texts.append(" ".join(base[:-1] + [word()]))  # of 10 words: 5 of 7 shingles
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    root, at = list(range(len(texts))), []
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            at += [j] if 0.7 <= j < 0.9 else []
            if j >= 0.8:
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert sum(j >= 0.8 for j in at) > 20 and sum(j < 0.8 for j in at) > 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect()) == sorted(set(root))


def test_wide_maps_differ_in_no_more_bits_than_sets_in_hashes():
    rng = np.random.default_rng(5)
    for n, m, shared in ((1025, 1025, 1025), (1500, 1400, 1300), (1100, 4096, 1000), (9000, 9000, 8100), (3000, 3000, 900)):
        h = rng.integers(-(1 << 63), 1 << 63, n + m - shared, dtype=np.int64)
        x, y = h[:n], h[n - shared :]
        found = simhash.maps_apart(simhash.wide_map(x), simhash.wide_map(y))
        assert found <= n + m - 2 * shared and found == simhash.maps_apart(simhash.wide_map(y), simhash.wide_map(x))
        bits = 1 << (min(n, m) - 1).bit_length()
        assert found == np.bitwise_count((simhash.parity_map(x, bits) ^ simhash.parity_map(y, bits)).view(np.uint64)).sum()
    assert simhash.wide_map(h[:1024]) is None


def test_long_texts_are_read_again_only_if_they_may_be_alike(spark, monkeypatch):
    """Texts with a long passage in common are candidates; 1024 bits are full at their length."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage, texts = [word() for _ in range(1500)], []
    for _ in range(6):
        own = [word() for _ in range(1500)]
        texts += [passage + own, passage + own[:-250] + [word() for _ in range(250)], passage + own[:-900] + [word() for _ in range(900)]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    read, write = [], simhash.Scratch.write

    def seen(self, df, tag):
        out = write(self, df, tag)
        if tag == "need":
            read.extend(r.node for r in out.collect())
        return out

    monkeypatch.setattr(simhash.Scratch, "write", seen)
    kept = sorted(r.doc_id for r in simhash.drop_near_copies(docs).collect())
    assert kept == [i for i in range(18) if i % 3 != 1]
    assert len(set(read)) == 12


def test_candidates_beyond_the_broadcast_give_the_same(spark, docs, monkeypatch):
    kept = lambda: sorted(r.doc_id for r in simhash.drop_near_copies(docs.where("doc_id IS NOT NULL")).collect())
    before = kept()
    monkeypatch.setattr("tessera.llm.common.FIND", 0)
    assert kept() == before


def test_lost_rows_go_to_the_texts_and_not_texts_to_them(spark, docs, monkeypatch):
    """Whether the planner takes the few rows for small must not decide if all texts are shuffled."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        for kept in (1 << 20, 0):
            monkeypatch.setattr("tessera.llm.common.FIND", kept)
            out = exact_dedup.drop_exact_copies(docs)
            ids = sorted(str(r.doc_id) for r in out.collect())
            assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == (kept > 0)
            if kept:
                first = ids
            assert ids == first and len(ids) < docs.count()
    finally:
        spark.conf.set(threshold, before)


# --- op9, op10 -----------------------------------------------------------------
def test_line_dedup(spark, sf_dir, texts, odd):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    n = {}
    for t in texts.values():
        for k in {key(x) for x in t.split("\n")} - {""}:
            n[k] = n.get(k, 0) + 1
    for r in queries.op9_line_dedup(spark, sf_dir).collect():
        lines = texts[r.doc_id].split("\n")
        kept = [x for x in lines if n.get(key(x), 0) < 10]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    got = line_dedup.drop_frequent_lines(odd, 3)
    assert got.count() == len(ODD) and {r.kept_text for r in got.where("doc_id in (1, 4)").collect()} == {""}
    assert line_dedup.drop_frequent_lines(empty(odd)).count() == 0


def line_rows(spark, texts):
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    return docs.select(F.explode(line_dedup.line_hashes(F.col("text"))).alias("h")).select("h.a", "h.b")


def test_runs_are_levelled_and_compacted(spark):
    runs = line_dedup.LineRuns(spark, min_docs=100, fanout=2)
    for i in range(5):
        runs.add(line_rows(spark, ["same\nown %d" % i]))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(r.n for r in runs.counts().collect()) == [1, 1, 1, 1, 1, 5] and runs.frequent().count() == 0
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_runs")]


def test_a_batch_leaves_out_what_a_run_knows_as_frequent(spark):
    runs = line_dedup.LineRuns(spark, min_docs=2, fanout=4)
    for batch in (["x\ny", "x"], ["x\ny\nz", "x"], ["z"]):
        runs.add(line_rows(spark, batch))
    assert [spark.table(t).count() for t in runs.levels[0]] == [2, 2, 1]
    assert runs.frequent().count() == 3
    runs.close()


def test_no_run_is_shuffled_or_sorted_again(spark):
    runs = line_dedup.LineRuns(spark, min_docs=2, fanout=8)
    runs.add(line_rows(spark, ["x\ny", "x"]))
    runs.add(line_rows(spark, ["z"]))
    with runs._sorted_scans():
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (runs.unknown(line_rows(spark, ["x"]).groupBy("a", "b").agg(F.count("*").alias("n"))), runs.counts())]
    assert plans[0].count("Exchange") == 1 and plans[0].count("Bucketed: true") == 2 and "SortMergeJoin" in plans[0]
    assert "Exchange" not in plans[1] and "Sort [" not in plans[1] and "SortMergeJoin" in plans[1]
    # The batch is combined before it is shuffled.
    assert plans[0].index("Exchange") < plans[0].index("partial_count")
    runs.close()


@pytest.mark.parametrize("mask", [-1, 3])
def test_exact_groups(docs, texts, mask):
    groups = {}
    for i, t in texts.items():
        groups.setdefault(t, []).append(i)
    got = exact_dedup.exact_groups(docs, block=256, mask=mask).collect()
    assert len(got) == len(texts)
    for r in got:
        own = groups[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(own), len(own), r.doc_id == max(own), sha(texts[r.doc_id]))


def test_exact_odd_rows(odd):
    got = exact_dedup.exact_groups(odd).collect()
    assert len(got) == len(ODD)
    cat = [r for r in got if r.doc_id in (1, 4)]
    assert [r.group_size for r in cat] == [3] * 3 and sum(r.kept for r in cat) == 1 and {r.keep_id for r in cat} == {4}
    left = exact_dedup.drop_exact_copies(odd)
    assert left.columns == odd.columns and left.count() == len({r[1] or "" for r in ODD})
    assert exact_dedup.exact_groups(odd, block=256, mask=3).count() == len(ODD)
    assert exact_dedup.exact_groups(empty(odd)).count() == 0 and exact_dedup.drop_exact_copies(empty(odd)).count() == 0


def test_names_are_places_in_sorted_order(spark):
    keys = spark.createDataFrame([(x * 7919 % 1000, x % 3) for x in range(2000)], "a long, b int")
    with exact_dedup.Scratch(spark) as scratch:
        got = sorted((r.a, r.b, r.name) for r in exact_dedup.sorted_names(keys, scratch).collect())
    assert [n for _, _, n in got] == list(range(len(got))) and [g[:2] for g in got] == sorted({(r.a, r.b) for r in keys.collect()})


def test_exact_repeated_rows_with_other_columns(spark):
    rows = [(1, "t", "b"), (1, "t", "a"), (0, "t", "c"), (None, "u", "x"), (None, "u", "y"), (3, "a" * 9000 + "b", "z"), (2, "a" * 9000 + "b", "z"), (4, "a" * 9000 + "c", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = exact_dedup.drop_exact_copies(docs, block=512).collect()
    assert sorted((r.doc_id or -1, r.text[-1]) for r in left) == [(-1, "u"), (1, "t"), (3, "b"), (4, "c")]


def test_nothing_but_the_result_stays_in_the_shared_folder(spark, docs):
    import pathlib

    folder = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir())
    exact_dedup.drop_exact_copies(docs).count()
    simhash.drop_near_copies(docs).count()
    left = {p.name.split("-")[0] for p in set(folder.iterdir()) - before if p.is_dir()}
    assert left <= {"lost", "again"}


def test_a_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace

    from tessera.llm.common import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))
