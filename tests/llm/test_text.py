import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidewright.llm import chat, decontaminate, html, licenses, textnum, toxicity, warc


def test_every_hash_of_equal_words_is_equal():
    column = pa.array(["one two", None, "", "two ünë"])
    for _, _, buf, at in textnum.slices(column):
        start, end, first = textnum.words(buf, at, textnum.SPACE)
        h = textnum.span_hash(textnum.prefix_hash(buf), start, end).tolist()
    assert first.tolist() == [0, 2, 2, 2, 4]
    assert h == [textnum.hash_text(w) for w in ("one", "two", "two", "ünë")]


def test_templates_match_as_their_regex():
    text = "Licensed under the Apache License, Version 2.0. This is licensed under the GNU General Public License version 3!"
    norm = " " + " ".join(licenses.tokens(text)) + " "
    words = [textnum.hash_text(w) for w in licenses.tokens(text)]
    for label, template in licenses.TEMPLATES.items():
        auto = licenses.compile_template(template)
        found = any(auto.accepts(words[i:]) for i in range(len(words)))
        assert found == bool(re.search(licenses.template_regex(template), norm)), label


def test_long_templates_match_whole(spark):
    words = " ".join(f"word{k}" for k in range(6000))
    docs = [(1, f"x {words} end"), (2, f"x {words.replace('word5999', 'other')} end"), (3, words.upper() + " end")]
    got = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), templates={"long": words + " <<any:0:2>> end"}).collect()
    assert {r.doc_id: [(s.label, s.words) for s in r.spans] for r in got} == {1: [("long", 6001)], 2: [], 3: [("long", 6001)]}


def test_cleaned_text_has_no_failing_line(spark):
    from tidewright.llm import quality

    text = "A good line stands here.\nHome | About | News | More\nAccept cookies to go on.\nno mark at its end\n\nAnd é the last one."
    got = quality.quality(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), clean=True).orderBy("doc_id").collect()
    assert got[0].clean_text == "A good line stands here.\n\nAnd é the last one." and got[0].n_bad_lines == 3
    assert [r.clean_text for r in got[1:]] == ["", ""]


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "ä" * 200
    pages = [(1, "http://a/", big), (2, "http://b/", "<b>x</b>"), (3, None, None), (4, "http://c/", big), (5, "u\r\nv", "<b>x</b>"), (None, "n", big), (4, "http://c/", big)]
    index = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = sorted(warc.read_archives(index).collect(), key=str)
    assert len(got) == len(pages)
    for r in got:
        html_of = next(h or "" for p, _, h in pages if p == r.page_id)
        assert r.payload_digest == hashlib.sha256(html_of.encode()).hexdigest() and r.payload_bytes == len(html_of.encode())
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert bytes(r.payload) == html_of.encode()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got if r.page_id in (1, 2, 4)} == {(1, "response", None), (2, "response", None), (4, "revisit", 1)}
    # only the selected records are read
    assert [r.page_id for r in warc.read_archives(index.where("page_id = 2")).collect()] == [2]


def test_ranges_coalesce():
    assert warc.ranges([(0, 10), (10, 10), (100, 5)], gap=20, most=1000) == [(0, 20, [(0, 10), (10, 10)]), (100, 105, [(100, 5)])]
    assert len(warc.ranges([(0, 10), (10, 10)], gap=20, most=15)) == 2


def test_chat_parts_and_escapes(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>", "\\l \\b < [ \\", "", None, "a\nb"]
    parts = [[("text", t, None, None)] for t in nasty]
    parts[0] += [("image", None, "img1", 2.0), ("text", " after ", None, None), ("audio", None, "snd", 1.5), ("document", None, None, None)]
    rows = [(1, k, "assistant" if k % 2 else "us\ner", p) for k, p in enumerate(parts)]
    chats = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}"))
    out = chats.first()
    assert [(a.position, a.turn, a.type, a.ref, a.tokens) for a in out.attachments] == [(0, 0, "image", "img1", 512), (1, 0, "audio", "snd", 38), (2, 0, "document", None, 1024)]
    assert out.attachment_tokens == 512 + 38 + 1024 and out.formatted.count("<|turn|>") == len(rows)
    assert "</s>" not in out.formatted and "[INST]" not in out.formatted
    back = chat.read_back(chats).first()
    assert [t.role for t in back.turns] == [r[2] for r in rows]
    assert [t.text for t in back.turns][1:] == [t or "" for t in nasty[1:]]
    assert back.losses == [t or "" for t in nasty[1::2]]


def test_spaced_seeds_find_substituted_passages(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, n)) for k, n in enumerate([40, 25, 16, 8, 3])] + [(9, None)]
    docs, want = [(0, prose(rng, 300)), (1, None), (2, "")], set()
    for k, text in items[:4]:
        w = text.split()
        if len(w) > 13:
            w[len(w) // 2] = "other"
        docs.append((10 + k, prose(rng, 50) + " " + " ".join(w) + " " + prose(rng, 70)))
        want.add((10 + k, k))
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    tokens = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    for r in got:
        d, i = tokens(dict(docs)[r.doc_id]), tokens(dict(items)[r.item_id])
        best = max(sum(a == b for a, b in zip(d[s : s + len(i)], i, strict=False)) for s in range(len(d)))
        assert r.n_matched == best and r.n_matched >= 0.8 * r.n_words


def best_overlap(doc, item):
    """The most equal words of any segment of any diagonal with 13 of them and the share, by trying all."""
    best = 0
    for s in range(1 - len(item), len(doc)):
        same = np.array([doc[s + k] == w for k, w in enumerate(item) if 0 <= s + k < len(doc)])
        equal = np.concatenate([[0], np.cumsum(same)])
        n, m = np.arange(len(equal))[None] - np.arange(len(equal))[:, None], equal[None] - equal[:, None]
        best = max(best, int(np.where((m >= 13) & (5 * m >= 4 * n), m, 0).max()))
    return best


def test_overlaps_are_those_of_all_segments(spark):
    rng = random.Random(4)
    items = {k: prose(rng, n).split() for k, n in enumerate([27, 100, 16, *(rng.randrange(15, 60) for _ in range(30))])}
    docs = {}
    for k, words in items.items():
        w, n = list(words), len(words)
        if k in (0, 2):  # three words in the middle
            gone = range(n // 2 - 1, n // 2 + 2)
        elif k == 1:  # every fifth word
            gone = range(4, n, 5)
        elif k % 2:  # neighbours
            gone = {a + x for a in rng.sample(range(n - 3), max(1, n // 15)) for x in range(3)}
        else:
            gone = rng.sample(range(n), n // 5)
        for x in gone:
            w[x] = "other"
        docs[k] = prose(rng, 30).split() + w + prose(rng, 30).split()
    got = decontaminate.overlaps(
        spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    ).collect()
    plain = lambda words: [re.sub(r"\W", "", w) for w in words]
    want = {(d, i): m for d, x in docs.items() for i, y in items.items() if (m := best_overlap(plain(x), plain(y)))}
    assert {(r.doc_id, r.item_id): r.n_matched for r in got} == want
    assert {(0, 0), (1, 1), (2, 2)} <= set(want) and want[0, 0] == 24 and want[1, 1] == 80
    for r in got:
        d, i = plain(docs[r.doc_id])[r.first_word :][: r.n_words], plain(items[r.item_id])
        assert 5 * r.n_matched >= 4 * r.n_words and any(sum(a == b for a, b in zip(d, i[s:], strict=False)) == r.n_matched for s in range(len(i) - r.n_words + 1))


def missed_pattern(masks, most=120):
    """The shortest pattern of equal (1) and other words with 13 equal ones or more and a fifth of others at most that holds no mask: all patterns are walked by their last words."""
    keep = max(map(len, masks)) - 1
    ends = np.arange(1 << (keep + 1))
    hit = np.any([(ends & int(m, 2)) == int(m, 2) for m in masks], axis=0)
    others = np.full(1 << keep, 10**6)
    others[0] = 0
    for n in range(1, most + 1):
        grown = np.where(hit, 10**6, np.repeat(others, 2) + (1 - (ends & 1)))
        others = np.full(1 << keep, 10**6)
        np.minimum.at(others, ends & ((1 << keep) - 1), grown)
        k = int(others.min())
        if n - k >= 13 and 5 * k <= n:
            return n, k
    return None


def test_masks_miss_no_overlap_and_each_is_needed():
    masks = decontaminate.MASKS
    assert all(m.count("1") >= 7 and "0" in m for m in masks)
    assert missed_pattern(masks) is None
    for m in masks:
        assert missed_pattern([x for x in masks if x != m]) is not None


def test_without_its_masks_nothing_is_found(spark, monkeypatch):
    rng = random.Random(11)
    item = prose(rng, 40).split()
    near = [w if k % 5 else "other" for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, prose(rng, 30) + " " + " ".join(near) + " " + prose(rng, 30))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert decontaminate.overlaps(docs, bench).count() == 1
    monkeypatch.setattr(decontaminate, "MASKS", ("1111111111111",))
    assert decontaminate.overlaps(docs, bench).count() == 0


def test_a_full_bitmap_and_short_tiles_give_the_same(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = {tuple(r) for r in decontaminate.overlaps(docs, bench).collect()}
    for name, value in (("FILTER_BITS", 64), ("TILE", 7), ("BROADCAST_TEXTS", 0)):
        monkeypatch.setattr(decontaminate, name, value)
    assert {tuple(r) for r in decontaminate.overlaps(docs, bench).collect()} == whole and whole
    assert decontaminate.clean(docs, bench).count() == docs.count() - len({r[0] for r in whole})


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"]).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    right = [r.predicted == r.toxic for r in scored]
    assert sum(right) >= 0.95 * len(right)
    # few labels: most, not all, toxic texts are found, and no clean one is called so
    assert sum(r.predicted for r in scored if r.toxic) >= 0.6 * sum(r.toxic for r in scored) and not [r for r in scored if r.predicted and not r.toxic]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)


def test_toxicity_on_more_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"]).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert sum(r.predicted for r in scored if r.toxic) >= 0.9 * sum(r.toxic for r in scored)
    assert sum(r.predicted for r in scored if not r.toxic) <= 0.005 * len(scored)


def test_patterns():
    texts = ["YOU ARE ALL BAD", "what now?!!", "f**k off", "you are such an idiot", "you stupid idiot", "Hello there. U*S", "a!! !b", None, "stop it!", "!!"]
    names = {textnum.hash_text(x): x.removeprefix("pattern:") for x in toxicity.PATTERNS}
    got = [set() for _ in texts]
    for a, _, buf, at in textnum.slices(pa.array(texts)):
        key, owner = toxicity._features(buf, at)
        for k, o in zip(key.tolist(), owner.tolist(), strict=True):
            if k in names:
                got[a + o].add(names[k])
    assert got == [{"shouts"}, {"marks"}, {"starred"}, set(), {"said"}, set(), set(), set(), set(), set()]


def test_voters_against(spark):
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    votes = np.stack([rng.random(4000) < np.where(y, 0.5, 0.03) for _ in range(3)] + [rng.random(4000) < np.where(y, 0.02, 0.6) for _ in range(2)], 1)
    text, voter = np.nonzero(votes)
    q, _ = toxicity.label_model(text, voter, len(y), 5, 0.3, against=np.array([False] * 3 + [True] * 2))
    assert ((q > 0.5) == y).mean() > 0.9


def test_label_model_counts_repeating_voters_once():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    base = np.stack([(rng.random(4000) < np.where(y, 0.5, 0.02)) for _ in range(4)], 1)
    votes = np.concatenate([base, base[:, :1], base[:, :1]], 1)
    text, voter = np.nonzero(votes)
    q, share = toxicity.label_model(text, voter, len(y), votes.shape[1], 0.2)
    assert share[0] < 0.5 < share[1]
    assert ((q > 0.5) == y).mean() > 0.9


def test_labeller_on_pages_it_has_not_seen():
    pages, labels = html.training_set(150, 77)
    found = html.trained().label(pages)
    right = np.concatenate([(p >= 0.5) == np.array(y) for p, y in zip(found, labels, strict=True)])
    assert right.mean() > 0.995


def test_labeller_on_pages_of_other_shapes():
    from tests.llm.foreign_pages import PAGES

    right = n = 0
    for page, article in PAGES:
        blocks = html.leaves(page)
        texts = [b[1] for b in blocks]
        assert set(article) <= set(texts)
        for text, p in zip(texts, html.trained().label([blocks])[0], strict=True):
            right += (p >= 0.5) == (text in article)
            n += 1
    assert right >= 0.97 * n


def test_long_pages_are_labelled_as_whole_ones():
    pages, _ = html.training_set(40, 5)
    long = [b for page in pages for b in page]
    model = html.trained()
    x, _ = model.inputs(long)
    mask = np.ones((len(long), 1), bool)
    assert np.allclose(model.logits(x[:, None], mask, steps=7), model.run(x[:, None], mask)[0], atol=1e-3)


def test_leaves_of_broken_markup():
    page = '<title>no</title><p class="a>b">One <b>two<br>three<p>&amp;four &lt;five&gt;<!-- x <p>six --><script>"</p>"</script><ul><li>a<li>b</ul>tail &eacute <p'
    assert [b[1] for b in html.leaves(page)] == ["One two three", "&four <five>", "a", "b", "tail é"]
    assert html.leaves("") == [] and html.leaves("<<<>") != None  # noqa: E711


def test_leaves_lose_no_text_to_other_elements():
    texts = lambda page: [b[1] for b in html.leaves(page)]
    for x in ("<svg-icon></svg-icon>", "<button-group></button-group>", "<title-card></title-card>", "<svg/>", '<svg class="a>b" />', "<math/>", "<svg><title>no</title><path/></svg>", '<script data-x="a>b">no</script>'):
        assert texts(f"<p>one</p>{x}<p>two three</p>") == ["one", "two three"], x
    assert texts("<html><head><title>t</title><p>one<p>two</html>") == ["one", "two"] and texts("<head>one<p>two") == ["one", "two"]
    assert texts("<p>Area is <math><mi>r</mi></math> squared.") == ["Area is r squared."]
    assert texts("<p>one</p><object><p>two</p></object><button>three</button><p>four") == ["one", "two", "three", "four"]
    assert texts(f"<p data-x=\"{'a > b ' * 2000}\">one</p><p>two") == ["one", "two"]


def test_extract_reads_every_row(spark):
    article = "<html><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>Long text of   the\n article. </p></article><footer>Copyright</footer></body></html>"
    got = html.extract(spark.createDataFrame([(1, "u", article), (2, None, None), (3, "v", ""), (1, "u", article)], "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "Head\nLong text of the article.", 30)] * 2 + [(2, "", 0), (3, "", 0)]
