"""Language identification, personal data, quality, chats, URLs and HTML."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.llm import chat, html, langid, pii, quality, urlfilter


# Language identification


def test_codewords():
    for n in (1, 2, 3, 4, 5, 9, 30):
        code = langid.codewords(n)
        assert code.shape[0] == n and len({tuple(r) for r in code}) == n
        if n > 2:
            assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 2
            assert (np.abs(code.sum(0)) < n).all()


def test_held_out_accuracy(spark, sf_dir):
    got = langid.op3_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    rows = got.filter("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_margins(model: langid.Model, text: str) -> list[float]:
    """By a loop over characters, n-grams and bits."""
    seq, wide = [0], (1 << 32) - 1
    for c in text.lower().encode("utf-8", "replace"):
        kept = c if 97 <= c <= 122 or c >= 128 else 0
        if kept or seq[-1]:
            seq.append(kept)
    if seq[-1]:
        seq.append(0)
    sums = np.zeros(model.weights.shape[1])
    for i in range(len(seq)):
        h = 0
        for order in langid.ORDERS:
            c = seq[i + order - 1] if i + order - 1 < len(seq) else 0
            h = (h * int(langid._MIX[0]) & wide) ^ ((c + 257 * order) * int(langid._MIX[1]) & wide)
            g = (h ^ (h >> 15)) * int(langid._MIX[2]) & wide
            sums += model.weights[((g >> 13) ^ g) % langid.BUCKETS]
    return list(sums / len(seq) + model.bias)


def test_predictions_by_brute_force(spark, sf_dir):
    """n-grams counted one by one, and a loop over codewords, whatever texts stand beside one another."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    texts = [r["text"] for r in docs.limit(30).collect()] + ["a", "É", "x y", "日本", "one, two -- three", "1 b 2", "ß" * 40]
    got = model.predict(texts)
    for text, (lang, score) in zip(texts, got, strict=True):
        if not any(map(str.isalpha, text or "")):
            assert (lang, score) == ("und", 0.0)
            continue
        f = plain_margins(model, text)
        losses = [sum(t * np.log1p(np.exp(-c * m)) for t, c, m in zip(model.trust, code, f, strict=True)) for code in model.code]
        shares = [np.exp(min(losses) - x) for x in losses]
        best = min(range(len(losses)), key=losses.__getitem__)
        assert lang == model.langs[best] and abs(score - 1 / sum(shares)) < 1e-3
    for i, text in enumerate(texts):
        assert model.predict([text])[0][0] == got[i][0] and abs(model.predict([text])[0][1] - got[i][1]) < 1e-6


def test_sample_is_the_same_for_any_partitions(spark):
    """Many rows under one doc_id: more than the bound, which the same rows fill however the table is cut."""
    rows = [(7, f"the {i} and of it" if i % 2 else f"der {i} und die", "en" if i % 2 else "de") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (langid.train(d, max_rows=20) for d in (docs.repartition(3), docs.orderBy("text").repartition(11)))
    assert one.langs == two.langs and (one.weights == two.weights).all() and (one.bias == two.bias).all()


def test_unknown_texts(spark, hard, folder):
    got = {r["doc_id"]: r for r in langid.op3_langid(spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in hard.filter("doc_id IS NOT NULL").collect()}
    for i, r in got.items():
        if not texts[i] or not any(c.isalpha() for c in texts[i]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de")
    none = langid.train(hard.withColumn("lang", F.lit(None).cast("string")))
    assert none.predict(["some text", None]) == [("und", 0.0)] * 2
    one = langid.train(hard.withColumn("lang", F.lit("en")))
    assert one.predict(["some text", "1 2"]) == [("en", 1.0), ("und", 0.0)]


def test_long_texts_are_read_whole():
    rng = random.Random(1)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    feature = lambda t: (g := langid.grams([t])[0], np.bincount(g.ravel(), minlength=langid.BUCKETS))[1]
    rows = []
    for lang, letters in (("x", "abcd "), ("y", "wxyz "), ("z", "klmn ")):
        for _ in range(20):
            c = feature(make(letters, 200))
            at = np.flatnonzero(c)
            rows.append((lang, at, (c[at] / 202).astype(np.float32)))
    model = langid.fit(rows)
    long = make("abcd ", 900_000) + make("wxyz ", 1_500_000)
    assert model.predict([long, make("abcd ", 50), make("klmn ", 1_200_000), "a"])[0][0] == "y"
    assert [p[0] for p in model.predict([make("abcd ", 50), long, make("klmn ", 50)])] == ["x", "y", "z"]
    whole, parts = model.margins([long])[0], langid.grams([long])
    direct = sum(model.weights[o].astype(float).sum(0) for o in parts[0]) / len(parts[0][0]) + model.bias
    assert np.allclose(whole, direct, atol=1e-3)


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and (not 16 <= len(digits) <= 19 or doubled % 10):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_by_brute_force():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab@@..0123456789++- ()\n%_é") for _ in range(rng.randint(0, 60))) for _ in range(6000)]
    texts += [t for t, _ in pii.generated(300, 2)] + ["000.0.0.1 0256.1.1.1 1.2.3.4.5.6.7.8", "a" * 3000 + "@b", "+1" + " " * 3000]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), t
    pii.base_spans("1" * 300_000 + " " + "x@" * 100_000 + "a" * 300_000)  # in linear time


def test_gradients_are_right():
    tagger = pii.Tagger(1)
    tagger.p = {k: v.astype(float) for k, v in tagger.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, pii.CLASSES, (6, 3)).astype(np.uint8), np.array([[0, 1, 0], [1, 2, 0], [2, 0, 7], [2, 0, 8], [0, 3, 0], [0, 4, 0]])
    _, g = tagger.gradients(x, y)
    for k in ("embed", "xf", "hb", "bf", "out", "step", "bias"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep = tagger.p[k][at]
        tagger.p[k][at] = keep + 1e-3
        up = tagger.gradients(x, y)[0]
        tagger.p[k][at] = keep - 1e-3
        down = tagger.gradients(x, y)[0]
        tagger.p[k][at] = keep
        assert abs((up - down) / 2e-3 - g[k][at]) < 0.01


def test_tagger_on_held_out_texts():
    texts = pii.generated(300, 77)
    right = wrong = missed = 0
    for (_, spans), got in zip(texts, pii.tagged_spans([t for t, _ in texts], pii.default_tagger()), strict=True):
        right += len(set(got) & set(spans))
        wrong += len(set(got) - set(spans))
        missed += len(set(spans) - set(got))
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9


def test_national_phone_numbers():
    """Forms of four languages, some of which the tagger was not trained on; other numbers are none."""
    trained = ["030 12345678", "06 12 34 56 78", "0171/2345678", "612 34 56 78", "020 7946 0958", "07700 900123", "(0131) 496 0123", "(569) 555-6633"]
    held_out = ["0171 23 45 67 8", "01/23/45/67/89", "01 23 456 789", "912.345.678", "(0171) 234 5678"]
    contexts = ["please call {} tomorrow", "Tel.: {}", "rufen Sie {} an, bitte", "appelez le {} pour la suite", "llame al {} por favor."]
    for numbers, least in ((trained, 0.9), (held_out, 0.8)):
        texts = [(c.format(n), n) for n in numbers for c in contexts]
        got = pii.all_spans([t for t, _ in texts], pii.default_tagger())
        assert sum([t[a:b] for k, a, b in spans if k == "phone"] == [n] for (t, n), (_, spans) in zip(texts, got, strict=True)) >= least * len(texts)
    others = ["in the year 1998 there", "on 12/05/2021 and 2021-03-14 it", "a sum of 1,234,567 dollars", "on page 12 of 340", "version v1.2.34 is out", "at 10:45 today"]
    assert pii.all_spans(others, pii.default_tagger()) == [([], [])] * len(others)


def test_windows_are_reconciled():
    """A span is found wherever it lies on the grid of windows, once."""
    tagger = pii.default_tagger()
    filler = "the word and more of it " * 40
    found = 0
    for at in range(0, 400, 7):
        text = filler[:at] + " call (569) 555-6633 now " + filler[at:]
        (_, spans), = pii.all_spans([text], tagger)
        assert len(spans) <= 1
        found += bool(spans) and text[spans[0][1] : spans[0][2]] == "(569) 555-6633"
    assert found > 50
    assert pii.all_spans(["no digits here", "", "@"], tagger) == [([], [])] * 3


def test_pii_query_and_redaction(spark):
    texts = ["mail a.b@c.example.com or +1 (569) 555-6633", None, "", "é 4444333322221111 10.0.0.1", "x"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean == {0: "mail [EMAIL] or [PHONE]", 1: None, 2: "", 3: "é " + ("[CARD]" if brute_spans(texts[3])[0][0] == "card" or pii.luhn("4444333322221111") else "4444333322221111") + " [IP]", 4: "x"}
    found = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert [tuple(s) for s in found[0]["base"]] == brute_spans(texts[0])
    assert found[1]["spans"] == []


def test_pii_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.op5_pii(spark, sf_dir).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(docs[r["doc_id"]]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(filter(None, r["spans"].split(",")))
        assert [r["spans"].count(f"{k}:") for k in pii.KINDS] == [r[f"n_{k}"] for k in pii.KINDS]


# Quality


def test_lines(spark):
    lines = {
        "A sentence that says something.": False,
        "Home | News | About | Contact": True,
        "Title": True,
        "This site uses cookies to work": True,
        "a line of verse without an end": False,
        "": False,
        "Quoted end.”  ": False,
    }
    df = spark.createDataFrame([(k,) for k in lines], "line string")
    assert {r[0]: r[1] for r in df.select("line", quality.line_fails(F.col("line"))).collect()} == lines


def test_clean_text(spark):
    text = "Home | News | About | Contact\nA first sentence of ten words stands here for you.\n\nTitle\nA second one."
    docs = spark.createDataFrame([(1, text, 5), (2, None, 5), (3, "Home | News | About | Contact | More | Yes | No | Etc\nOne.", 5)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in quality.clean(docs).collect()}
    assert got[1]["clean_text"] == "A first sentence of ten words stands here for you.\n\nA second one." and got[1]["kept"]
    assert got[2]["clean_text"] == "" and got[2]["base_failed"] and not got[2]["kept"]
    assert not got[3]["kept"]


# Chats


def test_reply_trees(spark):
    """Branches are ranked, cycles have no path, lost parents are roots, texts come back."""
    rows = [(1, 1, None, "user", "hi <turn x>&amp;", 0.0), (1, 2, 1, "assistant", "</turn>\n#1", 1.0), (1, 3, 1, "assistant", None, 5.0), (1, 4, 3, "user", "why", 0.0), (1, 5, 9, None, "lost", -1.0), (2, 1, 2, "user", "a", 0.0), (2, 2, 1, "user", "b", 0.0), (None, 1, None, "user", "x", 0.0)]
    messages = spark.createDataFrame(rows, "conv_id long, msg int, parent int, role string, text string, score double")
    got = {(r["conv_id"], r["branch"]): r for r in chat.format_chats(messages, None).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (None, 1)}
    assert [tuple(t) for t in got[1, 1]["turns"]] == [("user", "hi <turn x>&amp;"), ("assistant", ""), ("user", "why")]
    assert [tuple(t) for t in got[1, 2]["turns"]] == [("user", "hi <turn x>&amp;"), ("assistant", "</turn>\n#1")]
    assert [tuple(t) for t in got[1, 3]["turns"]] == [("", "lost")]
    (span,) = got[1, 2]["loss"]
    assert got[1, 2]["formatted"][span["start"] : span["end"]] == "&lt;/turn&gt;\n&#35;1"
    assert chat.format_chats(messages).count() == 2


def test_conversations_with_repeated_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "é" * 5), (1, 1, "assistant", "é" * 5)]
    got = chat.format_chats(chat.linear(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(got) == 1 and got[0]["n_turns"] == 4 and [s["end"] - s["start"] for s in got[0]["loss"]] == [5, 5]


# URLs


def test_rules_and_terms():
    judge = lambda url: urlfilter.Judge().judge(url)[:4]
    assert judge("https://WWW.example.com/en/1?x") == ("www.example.com", "/en/1", "com/en/", "block")
    assert judge("http://a.example.com/en/71") == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert judge("http://x.example.net/de/8") == ("x.example.net", "/de/8", "example.net/de/8", "block")
    assert judge("http://notexample.net/de/8")[2:] == ("net/de/", "allow")
    assert judge("http://x.org/ES/") == ("x.org", "/ES/", None, "allow")
    assert judge("http://casino.fr/x")[3] == "block" and judge("http://casinova.fr/x")[3] == "allow"
    assert judge("http://ads.fr/ads/ads")[3] == "allow" and judge("http://ads.fr/track")[3] == "block"
    assert judge(None) == ("", "", None, "allow") and judge("porn") == ("", "", None, "block")
    assert judge("http://h#x/y") == ("h", "", None, "allow") and judge("a://b://c/d")[:2] == ("b:", "//c/d")
    assert judge("://") == ("", "", None, "allow")


def test_urls_from_elsewhere():
    """Urls that are in none of the driver's tables."""
    judge = urlfilter.Judge().judge
    blocked = [
        "https://best-online-casinos.test/welcome-bonus", "http://slots.test/free-spins/", "https://shop.test/buy/viagra_100mg", "http://files.test/photo-editor-keygen.zip",
        "https://cheap.meds.test/no-prescription", "http://sexy-singles.test/cams", "https://poker.test/odds?table=3", "http://test.test/payday-loans/apply", "HTTPS://XXX.TEST/A", "http://a.test/login?next=phishing",
    ]
    allowed = [
        "https://news.test/2024/05/parliament-votes", "http://essex.test/sussex/middlesex", "https://library.test/catalogue/alphabet", "http://garden.test/slotted-spoons", "https://uni.test/pharmacy/courses",
        "http://radio.test/listen?track=12", "https://docs.test/downloads/manual.pdf", "http://zoo.test/adult-tickets", "https://blog.test/how-we-fight-spam", "http://farm.test/free-range-eggs",
    ]
    assert [judge(u)[3] for u in blocked] == ["block"] * len(blocked)
    assert [judge(u)[3] for u in allowed] == ["allow"] * len(allowed)
    assert judge(blocked[0])[4] == "gambling,spam" and judge(allowed[0])[4] is None


def test_long_urls_ties_and_own_terms(spark, tmp_path):
    long = "http://h.test/" + "a/" * 200_000
    assert urlfilter.Judge().judge(long)[3] == "allow" and urlfilter.Judge().judge(long + "porn")[3] == "block"
    twice = (("allow", "h.test", "/a"), ("block", "h.test", "/a"), ("block", "test", "/"))
    assert urlfilter.Judge(twice).judge("http://x.h.test/a/b")[2:4] == ("h.test/a", "allow")
    rows = [("apple", 1, "fruit"), ("Plum", 2, "fruit"), ("pear", 1, None), (None, 5, "x"), ("fig", None, "x")]
    spark.createDataFrame(rows, "term string, weight int, category string").write.parquet(str(tmp_path / "terms"))
    terms = urlfilter.load_vocabulary(spark, str(tmp_path / "terms"))
    assert terms == [("Plum", 2, "fruit"), ("apple", 1, "fruit"), ("pear", 1, "")]
    pages = spark.createDataFrame([(1, "http://h/apple"), (2, "http://h/apple-pear"), (3, "http://h/PLUM"), (4, "http://casino.h/"), (5, None)], "page_id long, url string")
    got = {r["page_id"]: (r["verdict"], r["categories"]) for r in urlfilter.judge(pages, rules=(), terms=terms).collect()}
    assert got == {1: ("allow", None), 2: ("block", ",fruit"), 3: ("block", "fruit"), 4: ("allow", None), 5: ("allow", None)}
    words = [t for t, _, _ in urlfilter.default_terms()]
    assert len(words) == len(set(words)) and all(t.isalnum() for t in words)


def test_urls_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://xxx.fr/a", "mine", 3)], "page_id long, url string, host string, extra int")
    row = urlfilter.judge(pages).collect()[0]
    assert (row["host"], row["verdict"], row["extra"]) == ("xxx.fr", "block", 3)


# HTML


def page(main: str, layout: int = 0) -> str:
    wrap = (f"<article><h1>T</h1>{main}</article>", f'<div class="post-{layout} wide"><h1>T</h1>{main}</div>', f'<main><div id="content"><h1>T</h1>{main}</div></main>')[layout % 3]
    return (
        '<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header><p>Site name here</p></header><nav><ul><li><a href="/">Home</a></ul></nav>'
        f'<div class="cookie-banner"><p>We use cookies.</p></div><div id="wrap">{wrap}<aside><p>Other stories to read.</p></aside><div class="sidebar"><p>Side text is long enough to look like text.</p></div>'
        f'<div class="ad">Buy things now.</div><section id="comments"><p>{"A reader says a lot of things. " * 30}</p></section><form><p>Your name</p></form></div><footer>&copy; all</footer></body></html>'
    )


@pytest.mark.parametrize("layout", range(3))
def test_layouts(layout):
    text = html.extract(html.blocks(page("<p>First &amp; <b>bold</b>\n  text.<br>More.<p>Second &#233;&nbsp;x<ul><li>one<li>two</ul><blockquote>q</blockquote>", layout)), None)
    assert text == "T\nFirst & bold text. More.\nSecond é x\none\ntwo\nq"


def test_names_of_containers():
    assert html.extract(html.blocks('<div class="with-sidebar"><div class="promo-text">Buy.</div><div class="post-body">Own text.</div></div>'), None) == "Own text."
    assert html.extract(html.blocks('<div class="sidebar"><p>All there is.</p><nav>Menu</nav></div>'), None) == "All there is."


NESTED = {
    "named div": '<article><h1>Title</h1><div class="content"><p>{}</p></div><p>Closing words.</p></article>',
    "unnamed div": "<article><h1>Title</h1><div><p>{}</p></div><p>Closing words.</p></article>",
    "sections": '<article><h1>Title</h1><section class="lead"><p>A lead of the article.</p></section><section class="rest"><p>{}</p></section><section class="end"><p>Closing words.</p></section></article>',
    "main": '<main><h1>Title</h1><article><div class="post-body"><p>{}</p></div></article><p>Closing words.</p></main>',
    "class": '<div class="page-wrap"><div class="post-content"><h1>Title</h1><div class="text"><p>{}</p></div><p>Closing words.</p></div><div class="misc"><p>Not the article.</p></div></div>',
}


@pytest.mark.parametrize("name", NESTED)
def test_nested_containers_lose_nothing(spark, name):
    """Title, lead and closing words stay, whatever nested part holds most of the text."""
    bodies = [f"Sentence {i} of the text. " * (5 + i) for i in range(6)]
    rows = [(i, f"http://n.fr/{i}", f"<html><body><nav>Menu</nav>{NESTED[name].format(b)}<footer>end</footer></body></html>") for i, b in enumerate(bodies)]
    lead = ["A lead of the article."] if name == "sections" else []
    for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        want = "\n".join(["Title", *lead, bodies[r["page_id"]].strip(), "Closing words."])
        assert r["text"] == want
        assert html.extract(html.blocks(rows[r["page_id"]][2]), None) == want


def test_hosts_agree_on_a_path(spark):
    """A page whose own best container is another one follows its host."""
    rows = [(i, f"http://a.fr/{i}", page(f"<p>{'Text of the page, number %d. ' % i * 20}</p>", 1)) for i in range(12)]
    odd = '<html><body><div class="junk"><p>' + "Long text that is not the page's own, again and again. " * 40 + '</p></div><div id="wrap"><div class="post-7 wide"><p>Short one.</p></div></div></body></html>'
    rows += [(50, "http://a.fr/odd", odd), (51, None, None), (52, "http://b.fr/", ""), (53, "http://c.fr/", "no markup at all &lt;"), (54, "http://a.fr/x", "<p>broken <div"), (55, "http://c.fr/2", odd), (50, "http://a.fr/odd", odd)]
    got = [(r["page_id"], r["text"]) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    texts = dict(got)
    assert len(got) == len(rows)
    assert texts[3].startswith("T\nText of the page, number 3.") and "reader" not in texts[3]
    assert texts[50] == "Short one."
    assert texts[51] == texts[52] == "" and texts[53] == "no markup at all <" and texts[54] == "broken"
    assert texts[55].startswith("Long text")


VOTED = {
    "shop": ('<div class="top"><p>{lure}</p></div><div class="info"><h2>Details</h2><p>{body}</p></div>', "info"),
    "forum": ('<table><tr><td class="who"><p>{lure}</p></td><td class="said"><p>{body}</p></td></tr></table>', "said"),
    "press": ('<section class="lead"><p>{lure}</p></section><section class="rest"><p>{body}</p></section>', "rest"),
}


@pytest.mark.parametrize("host", VOTED)
def test_votes_beat_a_page_of_its_own(spark, host):
    """On one page in four another container has most text; its host's other pages say which one to take."""
    layout, _ = VOTED[host]
    rows, want = [], {}
    for i in range(12):
        lure, body = ("A line of little use. " * 40, f"The body of page {i} is short.") if i % 4 == 3 else ("Some words.", f"The body of page {i} goes on and on. " * 30)
        rows.append((i, f"http://{host}.fr/{i}", f"<html><body>{layout.format(lure=lure, body=body)}</body></html>"))
        want[i] = body.strip()
    odd = [html.extract(html.blocks(rows[i][2]), None) for i in (3, 7, 11)]
    assert all("of little use" in t for t in odd)
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].endswith(want[i]) and "of little use" not in got[i] for i in want)


HOSTILE = {
    "nested": "<div>" * 100_000 + "text",
    "classes": "".join(f'<div class="c{"x" * (i % 50)}">' for i in range(100_000)) + "text",
    "unmatched": "text" + "<span>" * 50_000 + "</p>" * 50_000 + "</div>" * 50_000,
    "paragraphs": "<span>" * 50_000 + "<p>" * 50_000 + "text",
    "lists": "<ul><li>" * 50_000 + "text",
    "cells": "<table><tr><td>" * 20_000 + "text",
    "quotes": "text" + "<a href='" * 100_000,
    "open tags": "text" + "<a " * 100_000,
    "brackets": "text" + "<" * 300_000,
    "comments": "text" + "<!-- " * 100_000,
    "scripts": "text" + "<script>x" * 50_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    import time

    began = time.process_time()
    found = html.blocks(HOSTILE[name])
    html.score(found)
    assert html.extract(found, None).startswith("text") or name == "classes"
    assert time.process_time() - began < 3


def test_long_paths_keep_apart():
    """Paths beyond the limit are digests: equal for equal beginnings only."""
    deep = lambda x: html.blocks(f'<div class="{x}">' + '<div class="part">' * 200 + "<p>Text of a page, long enough.</p>")
    a, b, c = deep("one"), deep("one"), deep("two")
    assert a.paths == b.paths and max(map(len, a.paths)) <= html.LONG
    assert not set(a.paths) & set(c.paths) and len(set(a.paths)) == len(a.paths) == 201


def test_pages_of_the_driver(spark, sf_dir):
    import html as entities

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html.op6_html(spark, sf_dir).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("</?b>|<br>", lambda m: " " * (m[0] == "<br>"), p)).split()) for p in re.split("</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"])


def test_long_threads(spark):
    """Hundreds of replies, with branches far down, are walked in few rounds."""
    rng = random.Random(6)
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(300)] + [(1, 1000 + i, 250 if i == 0 else 999 + i, "assistant", str(i), 1.0) for i in range(30)]
    rows += [(c, i, rng.randrange(i) if i else None, "user", f"{c}.{i}", float(rng.randrange(3))) for c in range(2, 12) for i in range(rng.randrange(1, 40))]
    messages = spark.createDataFrame(rows, "conv_id long, msg int, parent int, role string, text string, score double")
    parent = {(r[0], r[1]): r[2] for r in rows}
    text = {(r[0], r[1]): (r[3], r[4]) for r in rows}
    want = set()
    for c, m in parent:
        if (c, m) not in {(r[0], r[2]) for r in rows}:
            path, at = [], m
            while at is not None:
                path.append(text[c, at])
                at = parent[c, at]
            want.add((c, tuple(reversed(path))))
    got = chat.format_chats(messages, None).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    assert {(r["conv_id"], tuple(map(tuple, r["turns"]))) for r in got} == want and len(got) == len(want)
    best = {r["conv_id"]: r for r in chat.format_chats(messages).collect()}
    assert best[1]["n_turns"] == 281 and best[1]["score"] == 30.0
