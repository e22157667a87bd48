import hashlib
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pairsmith.llm import chat_windows as chat
from pairsmith.llm import decontaminate, html_text, language_id, near_duplicates, personal_data, piece_codec, sharding, token_count, vector_search

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, None), (2, ""), (3, "word"), (3, "word"), (None, "the end of it"), (4, "x " * 30_000), (5, "a" * 5_000)]


def odd(spark, **more):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash."""
    return spark.createDataFrame([(k, t, "en", None, -1) for k, t in ODD], "doc_id long, text string, lang string, source string, n int")


def fuzz(n, letters, most, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    texts = fuzz(2000, ["a", "'s", "'re", "'l", " ", "  ", "\n", "é", "漢", "1", "!", "<|endoftext|>", "the", "X", "\u0085", "ve"], 30) + [" " * n for n in range(60)] + [t or "" for _, t in ODD]
    want = [len(e.ids) for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert token_count.Counter(BPE).count(texts) == want
    got = token_count.token_counts(odd(spark), BPE).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter(zip([k for k, _ in ODD], want[-len(ODD) :], strict=True))
    assert token_count.token_counts(odd(spark).limit(0), BPE).count() == 0


def test_splitter_scan_over_chunks():
    codes = np.array([ord(c) for c in "it's  a\n\n test 12 " * 300], np.uint32)
    whole = token_count.starts(codes)
    text = "".join(map(chr, codes))
    import regex

    want = [m.start() for m in regex.finditer(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", text)]
    assert whole.tolist() == want


def test_piece_codec(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = fuzz(2000, ["a", " ", "   ", "\n", "é", "漢", "12", "!", "<s>", "the", "▁", "💩", "ing"], 25) + [" " * n for n in range(50)] + [t or "" for _, t in ODD]
    c = piece_codec.Codec(PIECES)
    assert [c.encode(t) for t in texts] == model.encode(texts, num_threads=1)
    assert [c.decode(c.encode(t)) for t in texts] == [model.decode(model.encode(t)) for t in texts]
    got = piece_codec.encode(odd(spark), PIECES).collect()
    assert len(got) == len(ODD) and all(r.exact and r.n_pieces == len(r.ids) for r in got)


def test_html():
    page = """<html class="has-sidebar"><head><title>t</title></head><body><header>H</header><nav>menu</nav><div class="ad">buy</div>
    <main><h1>A &amp; B</h1><p>One,  two<br>three<p>Four <b>five</b> <a href="x>y">six</a><script>var a = "</p>";</script>
    <form><p>mail</p></form><ul><li>x<li>y</ul><div id="comments"><p>me too, very long comment, yes, yes</p></div></main><footer>f</footer>"""
    assert html_text.main_text(page) == "A & B\nOne, two three\nFour five six\nx\ny"
    plain = '<div class=side>a | <a href=1>b</a></div><div id=body><p>' + "long text, with commas, " * 9 + "</p><p>short</p></div>"
    assert html_text.main_text(plain).endswith("short") and "a |" not in html_text.main_text(plain)
    assert [html_text.main_text(x) for x in (None, "", "<p></p>", "bare", "<b")] == ["", "", "", "bare", ""]


@pytest.mark.parametrize("name", ["page has-sidebar", "content-with-sidebar", "no-ads", "social-science", "print-only", "legal"])
def test_html_keeps_articles_in_elements_named_like_noise(name):
    p = "<p>" + "long text, with commas, " * 9 + "</p>"
    want = ("long text, with commas, " * 9).strip()
    for outer, end in ((f'<div class="{name}">', "</div>"), (f'<div id="{name}"><form>', "</form></div>"), ("<form>", "</form>")):
        for inner in (f"<article>{p}</article>", p):
            assert html_text.main_text(f'<nav>a menu, of words, and more</nav>{outer}{inner}<div class="comments">{p}{p}{p}</div>{end}<div class="cookies">{p}</div>') == want
    assert html_text.main_text(f"<div class='{name}'>short</div>") == "short"
    # real comments go, many as they may be
    assert html_text.main_text(f'<div class="text">{p * 2}</div><div id="comments">{p * 9}</div><aside><article>{p}</article></aside>') == f"{want}\n{want}"


def test_html_keeps_sections_beside_the_container():
    long, short = "x, " * 6 + "y" * 482, "x, " * 2 + "y" * 194
    menu = "<div><a href=1>one of the pages of the menu</a> | <a href=2>another page of the menu</a></div>"
    page = f"<div class=content><div><p>{long}</p><p>{long}</p></div><div><p>{short}</p></div></div>"
    assert html_text.main_text(page) == f"{long}\n{long}\n{short}"
    page = f"<div>{menu}<div class=content>loose<div><p>{long}</p><p>{long}</p></div><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><figure><figcaption>c</figcaption></figure>and <b>more</b> text</div></div>"
    assert html_text.main_text(page) == f"loose\n{long}\n{long}\na\nb\n1\n2\nc\nand more text"
    # sections whose bodies are deeper in
    page = "".join(f"<div class=section><h2>{i}</h2><div><div><p>{t}</p></div></div></div>" for i, t in enumerate((long, short, short)))
    assert html_text.main_text(menu + page) == f"0\n{long}\n1\n{short}\n2\n{short}"


HARD_PAGES = {
    "unmatched": "<b>" * 90_000 + "</i>" * 90_000,
    "nested": "<div>" * 90_000 + "x" + "</div>" * 90_000,
    "unfinished": "<a " * 300_000,
    "inline around blocks": "<b>" * 50_000 + "<div></div>" * 50_000,
    "items below blocks": "<ul>" + "<div>" * 50_000 + "<li></li>" * 50_000,
    "scope": "<i><div>" + "<b>" * 90_000 + "</i>" * 90_000,
    "paragraphs": "<p>word, " * 100_000,
    "quotes": "<a b='" * 150_000,
    "comments": "<!--" * 200_000,
    "noise": "<div class=ad>" * 60_000 + "text of, words and" + "</div>" * 60_000,
}


@pytest.mark.parametrize("name", HARD_PAGES)
def test_html_of_a_megabyte_takes_linear_time(name):
    t0 = time.time()
    html_text.main_text(HARD_PAGES[name])
    assert time.time() - t0 < 4  # 0.8 s at most when written


def test_html_keeps_paragraphs_named_like_noise():
    p = "<p>" + "long text, with commas, " * 9 + "</p>"
    want = ("long text, with commas, " * 9).strip()
    assert html_text.main_text(f'<div class="content has-sidebar">{p}</div>') == want
    assert html_text.main_text(f'<div class="entry-content social-enabled">{p}{p}</div>') == f"{want}\n{want}"
    assert html_text.main_text(f'<div>{p}<p class="legal">The terms of the contract, as they were signed, hold.</p>{p}</div>') == f"{want}\nThe terms of the contract, as they were signed, hold.\n{want}"


def test_html_rows(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    df = spark.createDataFrame([(1, None, "old"), (1, "<p>a", "old")], "page_id long, html string, text string")
    assert Counter(r.text for r in html_text.extract(df).collect()) == Counter(["", "a"])


def test_language(spark):
    words = {"en": "the of and to in that".split(), "de": "der die und nicht ist ein".split(), "fr": "le la les des que est".split()}
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(words[k], k=20)), k, f"{k}.example.{k}") for i, k in enumerate(list(words) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = language_id.identify(df)
    assert got.where("lang_id <> lang or not lang_accepted").count() == 0
    model = language_id.fit(df, "lang", "text", "doc_id")
    more = language_id.identify(odd(spark).withColumn("lang_id", F.lit("clash")), model=model).collect()
    assert len(more) == len(ODD) and not any(r.lang_accepted for r in more if not r.text)
    junk = spark.createDataFrame([(1, "xqzk wvjq kkzx zzqw vkjq pqxz")], "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    assert not language_id.identify(junk, model=model).first().lang_accepted
    assert language_id.identify(df.limit(0)).count() == 0
    # a host seen with one language decides a text that says nothing
    short = spark.createDataFrame([(1, "zu", None, "de.example.de")] + [(i, "der die und nicht ist", "de", "de.example.de") for i in range(2, 60)], "doc_id long, text string, lang string, source string")
    assert language_id.identify(short, model=model).where("doc_id = 1").first().lang_id == "de"


LANG_ROWS = "doc_id long, text string, lang string, source string"


def test_language_models_of_many_and_of_rare_languages(spark, monkeypatch):
    rng = random.Random(5)
    tags = [f"q{a}{b}" for a in "abcdefgh" for b in "abcdefghi"]
    words = {t: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(12)] for t in tags}
    rows = [(i, " ".join(rng.choices(words[t], k=15)), t, None) for i, t in enumerate(tags * 25)]
    rows.append((-1, "\u03bb\u03cc\u03b3\u03bf\u03c2 \u03ba\u03b1\u03b9 \u03bc\u03ad\u03c4\u03c1\u03bf", "el", None))
    got = language_id.identify(spark.createDataFrame(rows, LANG_ROWS))
    assert got.where("lang_id <> lang or not lang_accepted").count() == 0  # el has no model but stays
    # a common language takes no row of a rare one
    monkeypatch.setattr(language_id, "TRAIN_ROWS", 50)
    rows = [(i, "the of and to in that word", "en", None) for i in range(4000)] + [(4000 + i, "\u03ba\u03b1\u03b9 \u03c4\u03bf \u03bb\u03cc\u03b3\u03bf\u03c2 \u03bc\u03ad\u03c4\u03c1\u03bf", "el", None) for i in range(8)]
    got = language_id.identify(spark.createDataFrame(rows, LANG_ROWS))
    assert got.where("lang_id = lang and lang_accepted").count() == 4008


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_shingles_of_words_made_to_collide():
    """Words over which polynomials modulo powers of two agree; and words of all lengths around the eight bytes read at once."""
    from pairsmith.llm.shingles import shared, shingle_sets

    first = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    texts = [first, first.translate(str.maketrans("ab", "ba")), *("x" * n for n in range(1, 140)), *(f"a {'x' * n}" for n in range(1, 20)), "a b c d e", "e d c b a", "A  B\tc d E", "a b c d", "a b c d d"]
    sets = shingle_sets([t.encode() for t in texts])
    assert len({s[0] for s in sets}) == len(texts) - 1 and [len(s) for s in sets] == [1] * len(texts)
    assert (sets[-3] == sets[-5]).all()
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["x", "yy", "z" * 9, "w" * 17, "q" * 71, "é" * 5], k=rng.randint(0, 25))) for _ in range(300)] + ["", " \n"]
    sets, want = shingle_sets([t.encode() for t in texts], 5, 2), [shingles(t) for t in texts]
    assert all(shared(sets[i], sets[j]) == len(want[i] & want[j]) for i in range(300) for j in range(i, 302, 7))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed, monkeypatch):
    if seed == 2:  # the other side of every bound
        for name, value in {"LISTED": 5, "OPENED": 3, "FREQUENT": 2, "OVERALL": 2, "WINDOW": 50}.items():
            monkeypatch.setattr(near_duplicates, name, value)
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(4, 60))] for _ in range(20)]
    docs = []
    for i in range(400):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            b[rng.randrange(len(b))] = rng.choice(vocab)
        docs.append((i, " ".join(b)))
    docs += [(1000, None), (1001, ""), (1002, " \n"), (0, docs[0][1]), (None, "lone wolf")]
    sets, parent = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    want = Counter((k, len(s), low.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(docs, sets, strict=True)))
    df = spark.createDataFrame([(k, t, 0) for k, t in docs], "doc_id long, text string, node int").repartition(4)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df).collect()) == want
    assert near_duplicates.near_duplicates(df.limit(0)).count() == near_duplicates.one_of_each(df.limit(0)).count() == 0
    kept = near_duplicates.one_of_each(df)
    assert kept.count() == len({find(i) for i, s in enumerate(sets) if s}) + sum(not s for s in sets)
    assert kept.columns == df.columns


def test_sharding(spark):
    df = odd(spark).unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("x").alias("lang"), F.lit("y").alias("source"), F.lit(0).alias("n")))
    got = sharding.assign(df, sharding.SlotMap.of(24)).toPandas()
    assert len(got) == 3000 + len(ODD)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) == {24}
    assert got.groupby("doc_id")["shard"].nunique().max() == 1
    r = got[got["doc_id"] == 5].iloc[0]
    assert (int(got[got["size"] == 5008].iloc[0].text_crc32)) == zlib.crc32(b"a" * 5000) and r["shard"] < 24
    m = sharding.SlotMap.of(4, 64)
    assert {m.owners.count(s) for s in range(4)} == {16} and m.version == 4
    load = {i: 1 + 50 * (i == 0) for i in range(64)}
    b = m.rebalanced(load)
    weigh = lambda x: max(sum(load[i] for i, o in enumerate(x.owners) if o == s) for s in range(4))
    assert weigh(b) < weigh(m) and b.version == 5
    assert sharding.slot_bytes(df).agg(F.sum("rows")).first()[0] == len(got)


def test_personal_data(spark):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def base(t):
        out = []
        for k, p in kinds.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                    out.append((k, m.start(), m.end()))
        return out

    texts = fuzz(1500, [*"aB129.@-+% ()", "4111 1111 1111 1111", "x@y.co", "1.2.3.4", "+49 30 1234567", "é", "💩", "@a.b", "000255.1.2.3"], 30, 5) + ["1" * 20_000, "a@b" + ".c" * 20_000, "1.2.3.4 " * 2000, None, "", "a" * 50_000 + "@"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii", F.lit(1)).repartition(8)
    found = personal_data.detect(df)
    names = [k.name for k in personal_data.KINDS if k.base]
    for r in found.collect():
        assert [(x.kind, x.s, x.e) for x in r.pii if x.kind in names] == base(texts[r.doc_id] or "")
    one = spark.createDataFrame([("mail é x@y.co now",), (None,)], "text string")
    assert {r.text for r in personal_data.redact(personal_data.detect(one)).collect()} == {"mail é [EMAIL] now", None}
    # many spans, overlapping spans, spans at both ends
    many = "x@y.co 1.2.3.4 é💩 " * 3000 + "5@b.cc"
    t0 = time.time()
    assert personal_data.redact(personal_data.detect(spark.createDataFrame([(many,)], "text string"))).first().text == "[EMAIL] [IP] é💩 " * 3000 + "[EMAIL]"
    assert time.time() - t0 < 60
    rng = random.Random(8)
    for _ in range(30):
        text = "".join(rng.choices("ab💩é ", k=rng.randint(0, 700)))
        spans = sorted((a, min(len(text), a + rng.randint(1, 40))) for a in rng.choices(range(max(1, len(text))), k=rng.randint(0, 12)) if a < len(text))
        want, at, i = "", 0, 0
        while i < len(spans):
            (a, e), i = spans[i], i + 1
            while i < len(spans) and spans[i][0] < e:
                e, i = max(e, spans[i][1]), i + 1
            want, at = want + text[at:a] + "[K]", e
        rows = spark.createDataFrame([(text, [("k", a, e) for a, e in spans])], "text string, pii array<struct<kind:string,s:int,e:int>>")
        assert personal_data.redact(rows).first().text == want + text[at:]
    assert personal_data.detect(df.limit(0)).count() == personal_data.redact(found.limit(0)).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    votes = {("person", (0, 1, 1, 0, 1)): 50, ("email", (1, 1, 1, 0, 1)): 500, ("card", (-1, -1, 0, -1, -1)): 500}
    model = personal_data.learn(votes)
    assert model.score("email", (1, 1, 1, 0, 1)) > 0.9 > 0.1 > model.score("card", (-1, -1, 0, -1, -1))


def test_decontamination(spark, monkeypatch):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 14)))) for i in range(30)] + [(3, "v1 v2"), (99, None), (None, "v1 v2 v3")]
    docs = [(i, " ".join(rng.choices([*vocab, "V1", "é-x"], k=rng.randint(0, 200)))) for i in range(60)] + [(60, None), (61, ""), (61, "")]
    docs += [(62 + i, f"zz {t} yy") for i, (_, t) in enumerate(items[:10])]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))

    def want(t):
        w, hit, own = words(t), set(), set()
        for k, text in items:
            v = words(text)
            for i in range(max(1, len(v) - 7) if v and k is not None else 0):
                g = v[i : i + 8]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit |= set(range(p, p + len(g)))
                        own.add(k)
        return len(w), sorted(hit), sorted(own)

    dd = spark.createDataFrame([(k, t, "old") for k, t in docs], "doc_id long, text string, items string").repartition(4)
    bb = spark.createDataFrame(items, "item_id long, text string")

    def got(df):
        return Counter((r.doc_id, r.n_words, tuple(x for s in r.hit_spans for x in range(s.s, s.e)), tuple(r["items"]), r.contaminated) for r in df.collect())

    expected = Counter((k, n, tuple(h), tuple(o), len(o) >= 2) for k, t in docs for n, h, o in (want(t),))
    assert got(decontaminate.contamination(dd, bb)) == expected
    assert got(decontaminate.contamination(dd, bb.limit(0))) == Counter((k, len(words(t)), (), (), False) for k, t in docs)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 6)  # a filter that lets nearly all through changes nothing
    monkeypatch.setattr(decontaminate, "CHUNK", 1 << 4)
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    assert got(decontaminate.contamination(dd, bb)) == expected
    assert got(decontaminate.contamination(dd.limit(0), bb)) == Counter()


def test_chat(spark):
    rng = random.Random(6)
    tricky = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user", "<\\s>", "<\\\\|im_start|>", "[\\INST]", "\\", "<", ""]
    for t in tricky + fuzz(500, ["<", "\\", "s>", "/", "|im_start|>", "[", "INST]", "a", "\n"], 12):
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)
        assert chat.parse_role(chat.format_role(t)) == t
    rows = []
    for c in range(40):
        for i in range(rng.randint(1, 12)):
            rows.append((c, i, "system" if i == 0 and c % 2 else rng.choice(["user", "assistant", "assistant", None]), rng.choice([*tricky, None, "word " * rng.randint(1, 80)])))
    rows += [(None, 0, "user", "x"), (7, 0, "user", "twice"), (7, 0, "user", "twice")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n_turns int").repartition(5)
    windows = chat.chat_windows(df, BPE, budget=120, history=2)
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((t, r is not None, r or "", x is not None, x or "") for k, t, r, x in rows if k == c)
        assert back[c].n_turns == len(own)
        assert back[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, _, x in own).encode()).hexdigest()
        loss = "".join(x for _, _, r, _, x in own if r == "assistant")
        assert (back[c].loss_chars, back[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in windows.collect():
        assert r.over_budget == (r.n_tokens > 120) and (not r.over_budget or r.n_turns - r.n_repeated == 1)
    assert chat.chat_windows(df.limit(0), BPE).count() == 0


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24))
    x[7], x[8] = x[9], x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, [1.0]), (40, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = vector_search.search(df, F.col("vec_id") % 20 == 0, rows_per_block=400, queries_per_block=30).toPandas()
    ids, all_x = np.append(np.arange(1500), 40), np.vstack([x, x[5]])
    hits = total = 0
    for q in range(0, 1500, 20):
        if q == 40:
            continue
        s = all_x @ x[q]
        s[q] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        part = got[got["query_id"] == q].sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21))
        assert np.allclose(part["score"], [max(all_x[ids == v] @ x[q]) if v == 40 else x[v] @ x[q] for v in part["vec_id"]])
        hits += len(set(want) & set(part["vec_id"]))
        total += 20
    assert hits / total >= 0.97
    assert len(got[got["query_id"] == 40]) == 40  # two rows with that id
    mixed = df.unionByName(spark.createDataFrame([(3000 + i, [float(i), 1.0]) for i in range(30)], df.schema))
    mixed = vector_search.search(mixed, F.col("vec_id").isin(3000, 3020, 20)).toPandas()
    assert mixed.groupby("query_id").size().to_dict() == {20: 20, 3000: 20, 3020: 20}  # each dimension among its own
    assert mixed[mixed["query_id"] == 3020].sort_values("rank")["vec_id"].tolist() == [3029 - i for i in range(9)] + [3019 - i for i in range(11)]
    assert vector_search.search(df.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vector_search.search(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_vector_search_recall_of_whole_blocks(spark):
    """Recall over two full blocks of random vectors, the hardest case for codes, in 64 and in 24 dimensions."""
    for dim in (64, 24):
        x = np.random.default_rng(dim).normal(size=(16_384, dim))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
        got = vector_search.search(df, F.col("vec_id") % 200 == 0).toPandas()
        hits = 0
        for q in range(0, 16_384, 200):
            s = x @ x[q]
            s[q] = -np.inf
            hits += len(set(np.argsort(-s)[:20].tolist()) & set(got[got["query_id"] == q]["vec_id"]))
        print("recall", dim, hits / (20 * 82))
        assert hits / (20 * 82) >= 0.98


def test_vector_search_equal_and_near_vectors(spark):
    """Large groups of copies, and of vectors that differ by less than their code, next to the queries."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    same, near = rng.permutation(3000)[:1000], rng.permutation(3000)[:600]
    x[near] = 3 * x[1] + rng.normal(size=(600, 16)) * 1e-9
    x[same] = 3 * x[0]
    x[0], x[100] = x[same[0]], x[near[0]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = vector_search.search(df, F.col("vec_id") % 100 == 0, rows_per_block=2000).toPandas()
    hits = 0
    for q in range(0, 3000, 100):
        s = np.einsum("d,rd->r", x[q], x)
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        hits += len(set(want) & set(got[got["query_id"] == q]["vec_id"]))
    print("recall", hits / 600)
    assert hits / 600 >= 0.97


CLASHING = "_text _key _id _tag _host _domain _suffix _top _ll _letters _known _best _prior _up _spans _raw _z0 _merged _k _h _text_hash own_text pii n_words hit_spans items contaminated lang_id lang_confidence lang_accepted text_hash component component_id n_shingles node tok g q u w h n".split()


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    more = docs.withColumns({c: F.concat(F.lit(f"{c} of "), "doc_id") for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, "/root/testdata/sf0.001"), stage(spark, more, "/root/testdata/sf0.001")
        assert out.columns == more.columns, name
        assert out.where(" or ".join(f"`{c}` <> concat('{c} of ', doc_id)" for c in CLASHING)).count() == 0, name
        assert Counter(map(tuple, out.select(docs.columns).collect())) == Counter(map(tuple, plain.collect())), name
    assert piece_codec.encode(more, PIECES).count() == token_count.token_counts(more, BPE).count() == docs.count()
    assert near_duplicates.near_duplicates(more).count() == sharding.assign(more, sharding.SlotMap.of(3)).count() == docs.count()


def test_slot_table_keeps_an_edited_map(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (5000 if i % 7 == 0 else 5)) for i in range(300)], "doc_id long, text string")
    sharding.write_slots(df, sharding.SlotMap.of(3), f"{tmp_path}/1")
    stored, sizes = sharding.read_slots(spark, f"{tmp_path}/1")
    assert stored == sharding.SlotMap.of(3) and sum(sizes.values()) == sum(5008 if i % 7 == 0 else 13 for i in range(300))
    edited = stored.rebalanced(sizes).moved(0, 5)
    sharding.write_slots(df, edited, f"{tmp_path}/2")
    assert sharding.read_slots(spark, f"{tmp_path}/2")[0] == edited != stored
    assert spark.read.parquet(f"{tmp_path}/2").agg(F.sum("rows")).first()[0] == 300


def test_sharding_of_repartitioned_rows(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("doc_id"), F.lit("same").alias("text")).repartition(9)
    got = sharding.assign(rows, sharding.SlotMap.of(5)).toPandas()
    assert len(got) == 5000
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd_docs = docs.unionByName(odd(spark).select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars")))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, sf)
        if name != "pieces":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        odd_docs = spark.read.parquet(str(tmp_path / name))
    assert 0 < odd_docs.count() <= docs.count() + 3
    assert corpus_pipeline.run(spark, sf).count() > 0


def plain_language(rows):
    """(lang_id, confidence, accepted) of rows (text, lang, source), one by one with dictionaries."""
    size, temper, strength = language_id.BUCKETS, language_id.TEMPER, 20.0

    def buckets(text):
        low = [(c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else "\0" for c in text or ""]
        kept = [c for i, c in enumerate(low) if i == 0 or c != "\0" or low[i - 1] != "\0"] + ["\0"]
        mixed = [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) % 2**64 for a, b, c in zip(*(map(ord, kept[i:]) for i in range(3)), strict=False)]
        return [(h >> 40) % size for h in mixed]

    tag_of = lambda x: (m[0].lower() if (m := re.match("[A-Za-z]{2,8}", (x or "").strip())) else None)
    counts = {}
    for text, lang, _ in rows:
        if tag_of(lang) and text is not None:
            counts.setdefault(tag_of(lang), Counter()).update(buckets(text))
    langs = sorted(k for k, v in counts.items() if v)
    total = {k: sum(counts[k].values()) + 0.5 * size for k in langs}

    def likelihoods(text):
        own = buckets(text)
        return [temper * sum(math.log((counts[k][b] + 0.5) / total[k]) for b in own) for k in langs] + [-temper * len(own) * math.log(size)]

    def levels(source):
        name = re.sub("[/?#:].*$", "", re.sub("^[a-z][a-z0-9+.-]*://", "", (source or "").lower()))
        parts = name.split(".")
        return name, ".".join(parts[-2:]) if len(parts) > 1 else name, parts[-1] if len(parts) > 1 else ""

    seen = []  # (tag, levels, language by the text alone)
    for text, lang, source in rows:
        ll = likelihoods(text)
        top = ll.index(max(ll))
        if any(map(str.isalpha, text or "")) and top < len(langs):
            t = tag_of(lang)
            seen.append((t if t in langs or t is None else "-", levels(source), top))
    n = len(langs)
    whole = [(sum(x[2] == i for x in seen) + 1) / (len(seen) + n) for i in range(n)]

    def prior(source):
        above = whole
        host, domain, suffix = levels(source)
        if not any(x[1] == (host, domain, suffix) for x in seen):
            return whole
        for match in (lambda x: x[1][2] == suffix, lambda x: x[1][1:] == (domain, suffix), lambda x: x[1] == (host, domain, suffix)):
            own = [sum(match(x) and x[2] == i for x in seen) for i in range(n)]
            above = [(c + strength * p) / (sum(own) + strength) for c, p in zip(own, above, strict=True)]
        return above

    said = sorted({x[0] for x in seen if x[0] is not None})
    trust = {t: [math.log((sum(x[0] == t and x[2] == i for x in seen) + 0.5 + 0.5 * (t == langs[i])) / (sum(x[0] is not None and x[2] == i for x in seen) + 0.5 * len(said) + 0.5)) for i in range(n)] for t in said}
    out = []
    for text, lang, source in rows:
        ll, t = likelihoods(text), tag_of(lang)
        t = t if t in langs or t is None else "-"
        own = [a + math.log(p) + (trust[t][i] if t in trust else 0) for i, (a, p) in enumerate(zip(ll, prior(source), strict=False))]
        best, unknown = max(own), ll[-1] + math.log(0.02)
        letters, modelled, other = any(map(str.isalpha, text or "")), best >= unknown, tag_of(lang) if t == "-" else None
        accepted = letters and (modelled or other is not None)
        rest = math.exp(min(unknown - best, 700))
        mass = sum(math.exp(x - best) for x in own)
        confidence = ((1 if modelled or other is None else rest) / (mass + rest)) if letters else 0
        out.append(((langs[own.index(best)] if modelled else other) if accepted else None, confidence, accepted))
    return out


def test_language_equals_brute_force(spark):
    rng = random.Random(11)
    words = {k: ["".join(rng.choices(a, k=rng.randint(2, 7))) for _ in range(60)] for k, a in (("aa", "abcdefgh"), ("bb", "efghijkl"), ("cc", "éèklmnop"))}
    hosts = ["one.site.aa", "two.site.aa", "http://three.org/x", "four", None, "big.host.com"]
    rows = []
    for i in range(300):
        k = rng.choice(list(words))
        text = " ".join(rng.choices(words[k], k=rng.randint(1, 12))) if rng.random() < 0.9 else rng.choice([None, "", "12 34", "xyzq wvuz ßßß", "a"])
        rows.append((text, rng.choice([k, k, k, k.upper() + "-x", None, "zz", "aa"]), "big.host.com" if i % 3 == 0 else rng.choice(hosts)))
    rows = [(t, None if g == "zz" and i % 2 else g, s) for i, (t, g, s) in enumerate(rows)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LANG_ROWS).repartition(5)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    for i, (lang, confidence, accepted) in enumerate(plain_language(rows)):
        assert (got[i].lang_id, got[i].lang_accepted) == (lang, accepted), rows[i]
        assert got[i].lang_confidence == pytest.approx(confidence, abs=2e-3), rows[i]


def test_pipeline_equals_brute_force(spark):
    """All that follows the first stage, one document after the other."""
    import sentencepiece

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.language(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()
    sets, group = {r.doc_id: shingles(r.text) for r in docs}, {r.doc_id: r.doc_id for r in docs}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                group[max(root(a), root(b))] = min(root(a), root(b))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = [grams(w, min(8, len(w))) for w in items if w]
    kept = [r for r in docs if not sets[r.doc_id] or root(r.doc_id) == r.doc_id]
    kept = [r for r in kept if not any(grams(words(r.text), len(next(iter(x)))) & x for x in windows)]
    assert 0 < len(kept) < len({root(r.doc_id) for r in docs}) < len(docs)
    spans = {r.doc_id: r.pii for r in personal_data.detect(spark.createDataFrame(kept, docs_schema(spark, sf))).collect()}
    model, want = sentencepiece.SentencePieceProcessor(model_file=PIECES), {}
    for r in kept:
        text, at, ends = "", 0, 0
        for x in sorted(spans[r.doc_id], key=lambda x: (x.s, x.e, x.kind)):
            if x.s < ends:
                at = ends = max(ends, x.e)
                continue
            text, at, ends = text + r.text[at : x.s] + f"[{x.kind.upper()}]", x.e, x.e
        text += (r.text or "")[at:]
        want[r.doc_id] = (len(text), model.encode(text))
    got = {r.doc_id: (r.n_chars, list(r.ids)) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want


def docs_schema(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").schema


def test_stages_of_empty_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), sf)
        assert out.count() == 0, name
        if name != "pieces":
            assert out.columns == docs.columns


def test_equal_rows_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EQUAL", 10)
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, None).otherwise(F.col("id") % 40).alias("doc_id"), F.lit("same").alias("text")).repartition(7)
    got = sharding.assign(rows, sharding.SlotMap.of(5)).toPandas()
    assert len(got) == 3000 and got["doc_id"].isna().sum() == 1000
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert sharding.assign(rows.limit(0), sharding.SlotMap.of(5)).count() == 0
