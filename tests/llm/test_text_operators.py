import itertools
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from kinmatch.llm import decontaminate, html_text, token_count, warc
from kinmatch.llm.common import scratch_path

from .helpers import SF, documents, prose, rows_of

SF01 = "/root/testdata/sf0.01"

# --- decontamination ------------------------------------------------------------

ITEM = prose("item", 40).split()


def leaky(spark, change=lambda w: w, at=50):
    words = prose("host", 120).split()
    return " ".join(words[:at] + change(list(ITEM)) + words[at:])


def substituted(k):
    def change(w):
        for i in range(k // 2, len(w), k):
            w[i] = f"swap{i}"
        return w

    return change


def found(spark, texts, items=((1, " ".join(ITEM)),)):
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.best_overlaps(documents(spark, list(texts)), bench).collect()}


def test_overlaps(spark):
    cased = lambda w: [x.upper() + "," for x in w]
    texts = [(1, leaky(spark)), (2, leaky(spark, cased)), (3, leaky(spark, substituted(9))), (4, prose("host", 300)), (5, None), (6, ""), (7, leaky(spark, lambda w: w[:20])), (8, leaky(spark, lambda w: w[:9])), (9, leaky(spark, substituted(3))), (None, leaky(spark))]
    got = found(spark, texts)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (7, 1), (None, 1)}
    assert (got[1, 1]["doc_start"], got[1, 1]["item_start"], got[1, 1]["overlap"], got[1, 1]["matched"]) == (50, 0, 40, 40)
    assert got[3, 1]["matched"] < got[3, 1]["overlap"]


def test_short_and_missing_items(spark):
    short = prose("short", 8)
    items = [(1, short), (2, "a b c"), (3, None), (4, ""), (5, short)]
    got = found(spark, [(1, f"{prose('z', 20)} {short} {prose('y', 20)}"), (2, "a b c " * 20)], items)
    assert set(got) == {(1, 1), (1, 5)}


def test_shortest_and_unspaced_items(spark):
    chinese, thai = "天地玄黄宇宙洪荒日月盈昃辰宿列张", "กขคงจฉชซญดตถทธนบปผฝพ"
    items = [(1, "Is it so?"), (2, chinese), (3, thai), (4, "好")]
    texts = [(1, "is it SO"), (2, "and is it so"), (3, f"他说{chinese[:7]}东{chinese[8:]}就走了"), (4, f"ฟภม{thai}ยรล"), (5, "好"), (6, "很好"), (7, f"他说{chinese[:7]}就走了")]
    assert set(found(spark, texts, items)) == {(1, 1), (3, 2), (4, 3), (5, 4)}


def test_all_passages_of_a_pair(spark):
    item = prose("long", 60).split()
    parts = item[:20] + [f"gap{i}" for i in range(15)] + item[35:]  # two parts on one diagonal
    text = " ".join(["start"] * 5 + parts + ["middle"] * 7 + item[10:30])
    got = found(spark, [(1, text)], [(1, " ".join(item))])[1, 1]
    assert [tuple(p) for p in got["passages"]] == [(5, 0, 20, 20), (40, 35, 25, 25), (72, 10, 20, 20)]
    assert (got["doc_start"], got["item_start"], got["overlap"], got["matched"]) == (40, 35, 25, 25)


def test_a_full_screen_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BITS", 8)  # every bit is set: all seeds reach the join
    monkeypatch.setattr(decontaminate, "LEAST_BITS", 8)
    items = [(i, prose(f"q{i}", 30)) for i in range(12)]
    got = found(spark, [(i, f"{prose(i, 40)} {t} {prose(i + 50, 40)}") for i, t in items], items)
    assert set(got) == {(i, i) for i in range(12)}


def test_masks_hit_every_pattern():
    for n in range(12, 24):
        for apart in itertools.combinations(range(n), n // 5):
            text = ["1" if i in apart else "0" for i in range(n)]
            assert any(all(c == "0" or t == "0" for c, t in zip(m, text[at:], strict=False)) for m in decontaminate.MASKS for at in range(n - len(m) + 1)), (n, apart)


def test_short_masks_hit_every_pattern():
    for n in range(6, 12):
        masks = decontaminate.short_masks(n)
        assert all(len(m) == n and m.count("1") >= 4 for m in masks)
        for apart in itertools.combinations(range(n), n // 5):
            assert any(all(m[i] == "0" for i in apart) for m in masks), (n, apart)
    numbers = [i for n in range(1, 13) for _, i in decontaminate.masks_of(n)]
    assert len(numbers) == len(set(numbers)) and max(numbers) < 127


def plain_overlap(a, b):
    """Whether some diagonal of two word lists has 12 or more words of which 80 % are equal, from an equal word to an equal word; of shorter items all words."""
    for d in range(-len(b), len(a)):
        if len(b) < 12:
            if 0 <= d <= len(a) - len(b) and 5 * sum(a[i + d] == b[i] for i in range(len(b))) >= 4 * len(b):
                return True
            continue
        same = [a[i + d] == b[i] for i in range(len(b)) if 0 <= i + d < len(a)]
        if any(same[i] and same[j - 1] and 5 * sum(same[i:j]) >= 4 * (j - i) for i in range(len(same)) for j in range(i + 12, len(same) + 1)):
            return True
    return False


def searched(text, item):
    """What the join finds, for one text and one item, in plain Python."""
    hashes = lambda words: decontaminate.word_hashes([" ".join(words).encode()], decontaminate.ALNUM_BYTES)
    (h, bounds), (words, _) = hashes(text), hashes(item)
    places = {}
    for s, at in zip(*(x.tolist() for x in decontaminate.item_seeds(words)), strict=True):
        places.setdefault(s, []).append(at)
    seeds, _, ats = decontaminate.text_seeds(h, bounds, [words.size] if words.size < 12 else [])
    diagonals = {p - q for s, p in zip(seeds.tolist(), ats.tolist(), strict=True) for q in places.get(s, ())}
    lines = ((h[max(0, d) : d + words.size], words[max(0, -d) : h.size - d]) for d in diagonals)
    return any(decontaminate.segments(a == b, h.size, words.size) for a, b in lines)


def test_recall_under_substitution():
    rng, missed, leaks = random.Random(7), [], 0
    cases = [(n, range(at, n, 5)) for n in (15, 20, 40, 60) for at in range(5)]  # every fifth word
    cases += [(n, apart) for n in range(6, 12) for k in (0, 1, 2) for apart in itertools.combinations(range(n), k)]
    cases += [(n, rng.sample(range(n), round(n * share))) for n in (12, 13, 15, 16, 20, 30, 45) for share in (0.1, 0.15, 0.2, 0.25) for _ in range(12)]
    for k, (n, apart) in enumerate(cases):
        item = [f"w{k}x{i}" for i in range(n)]
        passage = ["swap" if i in apart else w for i, w in enumerate(item)]
        text = [f"a{i}" for i in range(15)] + passage + [f"z{i}" for i in range(15)]
        got = searched(text, item)
        want = plain_overlap(text, item)
        leaks += want
        missed += [(n, sorted(apart))] if got != want else []
    assert leaks > 200 and not missed


def test_removal_judges_each_row(spark):
    docs = documents(spark, [(1, leaky(spark)), (1, prose(8)), (2, prose(3)), (None, prose(4)), (None, leaky(spark)), (3, None)])
    left = decontaminate.remove_leaks(docs, spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string"))
    assert left.columns == docs.columns
    assert rows_of(left, "doc_id", "text") == sorted([(1, prose(8)), (2, prose(3)), (3, None), (None, prose(4))], key=str)
    assert decontaminate.remove_leaks(docs.limit(0), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_hits_equal_a_plain_search(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = {}
    for r in bench.collect():
        w = words(r["text"])
        for i in range(len(w) - 12):
            grams.setdefault(tuple(w[i : i + 13]), set()).add(r["item_id"])
    want = set()
    for r in docs.collect():
        w = words(r["text"])
        for i in range(len(w) - 12):
            want |= {(r["doc_id"], x) for x in grams.get(tuple(w[i : i + 13]), ())}
    got = set(rows_of(decontaminate.query(spark, SF), "doc_id", "item_id"))
    assert want and want <= got and len(got - want) <= 2


# --- pages --------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body class="home"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div id="cookie-notice">We use</div><aside>side</aside><div class="ad">buy</div>
<article><h1>T &amp; U</h1><p>a  b
c<p>d <b>e</b>f<br>g<ul><li>one<li>two</ul><form><input name=x>ask</form><section class="comments"><p>reader says</p></section><!-- no --></article>
<footer>&copy; us</footer></body></html>"""


def test_extract():
    assert html_text.extract(PAGE) == "T & U\n\na b c\n\nd ef g\n\none\n\ntwo"
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<div> </div>") == ""
    assert html_text.extract("<p>plain</p>text &lt;b&gt;") == "plain\n\ntext <b>"
    assert html_text.extract("<article>un<p>closed <a href='x>y'>l</a>") == "un\n\nclosed l"
    assert html_text.extract('<div id="page" class="site"><div class="content no-sidebar"><article><p>in</p></article></div></div>') == "in"
    assert html_text.extract('<div class="widget"><main><p>in</p></main></div><div class="right sidebar"><p>out</p></div>') == "in"
    assert html_text.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "text": F.lit("t"), "template": F.lit(1), "sha": F.lit("s"), "first": F.lit(1)})


def test_templates_go_and_prose_stays(spark):
    bare = "<body><div><p>Welcome to our place</p></div><p>{}</p></body>"
    quoted = "<article><p>The same quote</p><p>{}</p></article>"
    rows = [(i, "http://a.example/x", bare.format(f"own {i}")) for i in range(8)] + [(100 + i, f"https://b.example:80/{i}", quoted.format(i)) for i in range(8)]
    rows += [(200, "http://c.example/", bare.format("alone")), (201, None, None), (202, "odd", ""), (0, "http://a.example/x", bare.format("own 0"))]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract_pages(pages(spark, rows)).collect()}
    assert got[3] == ("own 3", 5) and got[103][0] == "The same quote\n\n3"
    assert got[200][0] == "Welcome to our place\n\nalone" and got[201] == got[202] == ("", 0)
    assert html_text.extract_pages(pages(spark, rows)).count() == len(rows)
    assert html_text.extract_pages(pages(spark, rows).limit(0)).count() == 0


def test_templates_inside_articles_go(spark):
    boxes = "<div><p>Read our offers</p></div><ul><li>Home</li><li>Shop</li></ul><table><tr><td>Rates</td></tr></table>"
    page = "<main><article><h2>Facts</h2><p>own {0}</p>" + boxes + "<ul><li>salt</li><li>spice {0}</li></ul><table><thead><tr><th>Year</th></tr></thead><tr><td>{0}</td></tr></table></article></main>"
    rows = [(i, "http://a.example/x", page.format(i)) for i in range(8)]
    # one article at many addresses is not the template of its host
    rows += [(100 + i, f"http://b.example/{i}", f"<div><article><div><p>one text</p></div><div class='ad'>{i % 2}</div></article></div>") for i in range(8)]
    rows += [(200 + i, f"http://c.example/{i}", "<article>" + boxes + f"<p>own {i}</p></article>") for i in range(4)]
    # many copies of few articles: the share is that of different articles
    rows += [(300 + i, "http://d.example/", f"<article><section>Ask us</section><p>own {i % 6}</p></article>") for i in range(240)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(pages(spark, rows)).collect()}
    assert got[3] == "Facts\n\nown 3\n\nsalt\n\nspice 3\n\nYear\n\n3"
    assert {got[100 + i] for i in range(8)} == {"one text"}
    assert got[203] == "Read our offers\n\nHome\n\nShop\n\nRates\n\nown 3"
    assert got[301] == "own 1"


def test_slugs_inside_articles_drop_nothing():
    kept = '<h2 id="legal-history">a</h2><section id="skip-lists"><p id="related-work">b</p></section><h3><span id="Comments">c</span></h3>'
    assert html_text.extract(f'<article id="reply-to-critics">{kept}</article>') == "a\n\nb\n\nc"
    assert html_text.extract('<article><p>a</p><div id="comments">x</div><div id="cookie-notice">x</div><div class="share-box">x</div></article>') == "a"
    assert html_text.extract('<article id="comment-7">x</article><article>a</article>') == "a"


def test_names_count_as_a_whole():
    prose_ = '<section class="related-work"><p>a</p></section><p class="share-price">b</p><div class="legal-history">c</div><p class="legal">d</p><label>e</label><p>f <span class="comment">g</span></p>'
    assert html_text.extract(f"<article>{prose_}</article>") == "a\n\nb\n\nc\n\nd\n\ne\n\nf g"
    parts = '<div class="ad">x</div><div class="ad-slot-2">x</div><section class="related-posts">x</section><ul class="share-buttons"><li>x</ul><p class="advert">x</p><div class="comments-area"><p>x</div>'
    assert html_text.extract(f"<article><p>a</p>{parts}<p>b</p></article>") == "a\n\nb"
    assert html_text.extract('<form><label>x</label></form><div class="site-header">x</div><div class="with-sidebar"><p>a</p></div>') == "a"


def host_pages(n=9):
    """Pages without an article element whose menu, notice, box and footer recur, as does a box inside the articles of another host."""
    menu, foot = "<nav><ul><li>Home</li><li>News</li></ul></nav><div class='cookie'>We use cookies</div>", "<footer>All rights</footer>"
    bare = "<body>" + menu + "<div><p>own {0}</p><div class='promo'>Buy now</div><p>more {0}</p></div>" + foot
    own = "<body>" + menu + "<article><p>own {0}</p><div>Read our other pages</div></article>" + foot
    return [(i, f"http://a.example/{i}", bare.format(i)) for i in range(n)] + [(100 + i, f"http://b.example/{i}", own.format(i)) for i in range(n)]


def test_counts_alone_remove_the_template(spark, monkeypatch):
    for lists in ("DROPPED", "ROLES", "PARTS", "HEADER_PARTS", "COMMENTS"):
        monkeypatch.setattr(html_text, lists, frozenset())
    rows = host_pages()
    templates = {r["host"]: frozenset(r["template"]) for r in html_text.site_templates(pages(spark, rows)).collect()}
    for i, url, page in rows:
        own = templates[url.split("/")[2]]
        assert html_text.extract(page, own) == (f"own {i}\n\nmore {i}" if i < 100 else f"own {i - 100}")
        assert html_text.extract(page, own) != html_text.extract(page)  # without the counts it stays


def test_one_page_at_many_addresses_keeps_its_text(spark):
    copies = [(i, "http://a.example/", "<body><div><p>one text</p><p>its end</p></div>") for i in range(12)]
    few = [(100 + i, "http://b.example/", f"<body><p>Welcome</p><p>text {i % 6}</p>") for i in range(60)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(pages(spark, copies + few)).collect()}
    assert {got[i] for i in range(12)} == {"one text\n\nits end"}
    assert all(got[100 + i] == f"text {i % 6}" for i in range(60))


class PlainArticle(HTMLParser):
    """The blocks of the article element, for pages of simple markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.line = False, [], ""

    def end_block(self):
        if words := self.line.split():
            self.blocks.append(" ".join(words))
        self.line = ""

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in ("article", "p", "h1"):
            self.end_block()
        if tag == "br":
            self.line += " "

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1"):
            self.end_block()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.line += data


def test_all_pages_equal_a_plain_extraction(spark):
    rows = spark.read.parquet(f"{SF01}/pages.parquet").collect()
    got = {r["page_id"]: r for r in html_text.query(spark, SF01).collect()}
    assert len(got) == len(rows)
    for r in rows:
        plain = PlainArticle()
        plain.feed(r["html"] or "")
        want = "\n\n".join(plain.blocks)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])


def test_archives_round_trip(spark):
    big = "<p>" + "é" * 400_000 + "</p>"
    rows = [(1, "http://a\r\n/", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", big), (6, "u", big), (7, "u", "a\r\n\r\nb"), (2, None, "same"), (None, "u", "same"), (None, "u", "solo")]
    folder = scratch_path(spark, "t")
    index = warc.write_archives(pages(spark, rows), folder)
    got = warc.read_archives(index, folder).collect()
    ranges = warc.frame_ranges(index, 1).select("bundle", "first", "last", F.spark_partition_id().alias("part")).collect()
    frames = index.select("bundle", "frame").distinct().count()
    assert len({r["part"] for r in ranges}) == len(ranges) == frames > 1 and all(r["first"] == r["last"] for r in ranges)
    want = []
    for i, _, h in rows:
        heads = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(heads, default=None)
        revisit = first is not None and i != first
        body = (h or "").encode()
        want.append((i, len(body), warc.payload_digest(body), "revisit" if revisit else "response", first if revisit else None, None if revisit else body))
    key = lambda r: str(r[:5])
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"]) if r["payload"] != b"" else b"") for r in got), key=key) == sorted(want, key=key)
    where = index.filter("page_id = 5").first()
    fields, body = warc.fetch([(where["bundle"], where["frame"], where["at"])], folder)[0]
    assert fields["X-Page-ID"] == "5" and body == big.encode()


def test_reading_uses_all_cores(spark):
    rows = [(i, "u", f"<p>{prose(i, 4000)}</p>") for i in range(200)]
    folder = scratch_path(spark, "t")
    index = warc.write_archives(pages(spark, rows).coalesce(1), folder)
    assert index.select("bundle").distinct().count() == 1
    read = warc.read_archives(index, folder, payloads=False).withColumn("part", F.spark_partition_id())
    assert read.select("part").distinct().count() >= spark.sparkContext.defaultParallelism
    assert rows_of(read, "page_id") == sorted(((i,) for i, _, _ in rows), key=str)


def test_small_payloads_are_all_responses(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, "u", "same and longer"), (4, "u", "same and longer")]
    folder = scratch_path(spark, "t")
    got = warc.read_archives(warc.write_archives(pages(spark, rows), folder, least_revisit=5), folder)
    assert rows_of(got, "page_id", "record_type", "refers_to") == [(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3)]


def test_archives_of_nothing(spark):
    folder = scratch_path(spark, "t")
    index = warc.write_archives(pages(spark, [(1, "u", "h")]).limit(0), folder)
    assert index.count() == 0 and warc.read_archives(index, folder).count() == 0


# --- token counts ------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return token_count.Counter(token_count.Vocabulary.load(token_count.VOCABULARY))


def test_counts_equal_the_tokenizer(counter, spark):
    from sentencepiece import sentencepiece_model_pb2
    from tokenizers import Tokenizer, models, pre_tokenizers

    model = sentencepiece_model_pb2.ModelProto()
    with open(token_count.VOCABULARY, "rb") as f:
        model.ParseFromString(f.read())
    vocabulary = [(p.piece if p.type in (1, 6) else f"\0{i}", float(p.score) if p.type == 1 else 0.0) for i, p in enumerate(model.pieces)]
    tokenizer = Tokenizer(models.Unigram(vocabulary, 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", False)
    rng = random.Random(4)
    letters = "the anrt  e日é😀\nxz▁"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert [counter.of(t)[0] for t in texts] == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ties_go_to_the_earliest_start():
    made = token_count.Counter(token_count.Vocabulary.of([("a", -1.0), ("aa", -2.0), ("▁", -1.0), ("b", -5.0)]))
    assert made.viterbi("▁aa") == (2, -3.0) and made.viterbi("aaa") == (2, -3.0)
    assert made.viterbi("é") == (2, -15.0)
    with pytest.raises(ValueError):
        token_count.Vocabulary.of([("a▁b", -1.0)])


def test_count_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a"), (4, "word " * 50000)]
    got = token_count.token_counts(documents(spark, rows), token_count.Vocabulary.load(token_count.VOCABULARY)).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1: 0, 2: 0} and len(got) == len(rows)
