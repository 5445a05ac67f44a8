import random
import time

from pyspark.sql import functions as F

from marketloom.llm import wrapper


def page(i, extra="", notice="Read our weekly letter"):
    return (
        f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body><header>H{i}</header><nav><ul><li><a>m{i}</a><li>n{i}</ul></nav>"
        f"<div class='ad'>buy {i}</div><article><h1>Head {i} &amp; more</h1><p><b>Un<i>clo</i>sed {i}<br><p>Two\n\t words &eacute;{i}</p><p>{notice}</p>{extra}<div class='comments'><p>me too</p></div><form>f</form></article>"
        f"<aside>a{i}</aside><footer>&copy; {i}</footer></body></html>"
    )


def test_parts_that_are_not_text():
    assert wrapper.main_text(page(1)) == "Head 1 & more\nUnclosed 1\nTwo words é1\nRead our weekly letter"
    assert wrapper.main_text("<div>plain <!-- c > --> text &lt;b&gt;<br>x</div><div hidden>h</div>") == "plain text <b> x"
    assert wrapper.main_text("<article><p>cut off in the mid") == "cut off in the mid"
    assert wrapper.main_text("") == wrapper.main_text("<script>x") == wrapper.main_text("<<<>>") .replace("<<<>>", "") == ""
    assert wrapper.main_text("<article><table><tr><td>a<td>b<tr><th>c</table><ul><li>d<li>e</ul></article>") == "a\nb\nc\nd\ne"
    assert wrapper.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_names_that_hold_a_word_but_say_something_else_are_text():
    kept = "<article><h2 class='section-header'>A</h2><div class='related-work'>B</div><p class='share-price'>C</p><p class='lead header-2'>D</p></article>"
    assert wrapper.main_text(kept) == "A\nB\nC\nD"
    gone = "<article><p>A</p><div class='comment-list'>x</div><div class='ad-slot-2'>y</div><section id='comments'>z</section><p class='ad'>q</p><div class='siteFooter'>f</div></article>"
    assert wrapper.main_text(gone) == "A"


def test_plainly_named_parts_are_gone():
    for name in ["comments-section", "user-comments", "post-comments", "main-nav", "primary-menu", "ad-unit", "related-posts", "sidebar-primary", "cookie-banner-text", "newsletterSection"]:
        assert wrapper.main_text(f"<article><p>A</p><div class='{name}'><p>x</p></div><p>B</p></article>") == "A\nB", name
    for name in ["related-work", "section-title", "header-text", "shared-history", "addendum", "main-content", "navigational-aids"]:
        assert wrapper.main_text(f"<article><p>A</p><div class='{name}'><p>x</p></div><p>B</p></article>") == "A\nx\nB", name


def test_a_form_around_a_page_is_its_frame():
    inner = "<nav>n</nav><article><p>Story</p><form>mail<input></form></article><div>beside</div>"
    assert wrapper.main_text(f"<body><form id='form1' action=x><div>{inner}</div></form></body>") == "Story"
    assert wrapper.main_text("<form><header>h</header><div><p>No article</p></div><footer>f</footer></form>") == "No article"
    assert wrapper.main_text("<div><p>Text</p><form><p>Name</p><input></form></div>") == "Text"
    assert wrapper.main_text("<form><article><p>A</p></article></form><form><p>Name</p></form>") == "A"


def test_headings_of_an_articles_header_are_text():
    assert wrapper.main_text("<header><h1>Site</h1></header><article><header class='page-header'><h1>Title</h1><p>by me</p></header><p>A</p></article>") == "Title\nA"
    assert wrapper.main_text("<article><header hidden><h1>Title</h1></header><p>A</p><nav><header><h2>n</h2></header></nav></article>") == "A"


def test_broken_markup_is_read_once():
    assert wrapper.main_text("<article><p title=\"a>b\" class='x'>A<p it's>B<p title=\"open>C</article>") == "A\nB\nC"
    assert wrapper.main_text("<article><p>A</p></b></p></section>B</article><p>C<a href='x") == "A\nB"
    start = time.perf_counter()
    for piece, n in [("<p '", 100_000), ('<p a="', 100_000), ("<p a=\"' b='\"", 60_000), ("<a", 200_000), ("<!", 200_000), ("<!--", 100_000), ("<div></p>", 60_000), ("<p a=''", 100_000)]:
        wrapper.main_text(piece * n)
        wrapper.main_text(piece * n + ">x")
    assert time.perf_counter() - start < 60


def brute_match(a, b):
    if a.label != b.label:
        return 0
    m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
    for i, x in enumerate(a.children):
        for j, y in enumerate(b.children):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_match(x, y))
    return m[-1][-1] + (2 if a.label == "#text" and a.text == b.text else 1)


def test_tree_matching_and_packing():
    trees = [wrapper.parse(page(i, extra="<p>more</p>" * (i % 3)))[1] for i in range(4)]
    for a in trees:
        nodes = wrapper.unpack(wrapper.pack(a))
        assert wrapper.pack(nodes[0]) == wrapper.pack(a)
        for b in trees:
            assert wrapper._sizes(a, b, {}) == brute_match(a, b)
            assert len(wrapper.matched(a, b)) <= wrapper._sizes(a, b, {})


def test_long_lists_are_matched_in_order():
    a, b = (wrapper.parse("<ul>" + "".join(f"<li>{i * k}</li>" for i in range(100_000)) + "</ul>")[1] for k in (1, 2))
    assert len(wrapper.matched(a, b)) == 200_002


def grown(rng, depth):
    node = wrapper.Node(rng.choice(["div", "li", "p.a"]))
    for _ in range(rng.randrange(5)):
        node.children.append(grown(rng, depth - 1) if depth and rng.random() < 0.6 else wrapper.Node("#text", text=rng.randrange(12)))
    return node


def test_long_lists_are_matched_as_short_ones(monkeypatch):
    """The same pairs and sizes as by the plain table, whichever cells are held and whatever is weighed together."""
    def found(a, b):
        order = lambda n: [n, *(x for c in n.children for x in order(c))]
        number, pairs = {id(n): k for k, n in enumerate(order(a))}, wrapper.matched(a, b)
        return wrapper._sizes(a, b, {}), [number[id(pairs[id(n)])] if id(n) in pairs else None for n in order(b)]

    for seed in range(30):
        rng = random.Random(seed)
        a, b = wrapper.Node("ul"), wrapper.Node("ul")
        a.children = [grown(rng, rng.randrange(3)) for _ in range(rng.randrange(50))]
        # every other time the second list is the first with parts taken out and put in
        kept = [c for c in a.children if rng.random() < 0.9] if seed % 2 else []
        b.children = [grown(rng, 1) for _ in range(rng.randrange(6 if seed % 2 else 50))] + kept
        monkeypatch.setattr(wrapper, "MOST_PAIRS", 10**9)
        plain = found(a, b)
        monkeypatch.setattr(wrapper, "MOST_PAIRS", 0)
        for cells, like in [(1 << 23, 64), (1, 1), (300, 4)]:
            monkeypatch.setattr(wrapper, "CELLS", cells)
            monkeypatch.setattr(wrapper, "LIKE_PAIRS", like)
            assert found(a, b) == plain, (seed, cells, like)


def test_long_lists_find_what_moved(spark):
    """300 items are on every page behind 0 to 11 of its own: they are template, wherever they stand."""
    same = "".join(f"<li>Item {k}</li>" for k in range(300))
    a, b = (wrapper.parse("<ul>" + "".join(f"<li>new {k}</li>" for k in range(n)) + same + "</ul>")[1] for n in (0, 60))
    texts = {id(c.children[0]): c.children[0].text for c in b.children[0].children}
    assert sum(texts.get(k) == x.text for k, x in wrapper.matched(a, b).items()) == 300
    rows = [(i, "http://l.example/", f"<html><body><article><p>Story {i}</p><ul>{''.join(f'<li>Own {i} {k}</li>' for k in range(i))}{same}</ul></article></body></html>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join([f"Story {i}", *(f"Own {i} {k}" for k in range(i))]) for i in range(12)}


LIST = "<div class='x'><ul><li>{0}a</li><li>{0}b</li></ul></div>"


def test_constant_nodes_become_template(spark):
    rows = [(i, f"https://one.example/{i}", page(i)) for i in range(30)] + [(100, "https://few.example/a", page(7)), (101, None, page(8)), (102, "https://one.example/n", None), (103, "https://one.example/e", "")]
    rows += [(300 + i, "https://deep.example/", "<div>" * 5000 + f"deep {i}") for i in range(8)]
    rows += [(200 + i, "https://same.example/", page(9)) for i in range(12)]  # copies of one page are no evidence
    # a third of a host's pages have another layout with a notice of their own
    rows += [(400 + i, "https://two.example/", page(i, notice="One") if i % 3 else page(i, notice="Two").replace("<article>", "<article><section>").replace("</article>", "</section></article>")) for i in range(30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int").repartition(4)
    expected = {}
    for i, _, h in rows:
        t = wrapper.main_text(h or "")
        expected[i] = t.removesuffix("\nRead our weekly letter") if i < 30 else t.removesuffix("\nOne").removesuffix("\nTwo")
    got = {r["page_id"]: r for r in wrapper.extract(df).collect()}
    assert {i: r["text"] for i, r in got.items()} == expected
    # notice, comment and form are the same everywhere; the other blocks vary, and no container holds most of their text
    assert {(r["n_blocks"], r["n_template"]) for i, r in got.items() if i < 30} == {(12, 3)}
    assert sorted(map(tuple, wrapper.extract(df, most_bytes=0).collect())) == sorted(map(tuple, got.values()))
    assert wrapper.extract(df.limit(0)).count() == 0


def test_region_without_any_name_for_it(spark):
    """Only the alignment tells where the text is: no element and no class says so."""
    def plain(i):
        body = "".join(f"<div>part {i} {k} of the text that goes on for long enough to be most of the page</div>" for k in range(2 + i % 4))
        return f"<html><body><div class='x'>Site of {i % 2}</div>{LIST.format(i)}<div class='y'>{body}<div>Same everywhere</div></div><div class='z'>short {i}</div></body></html>"

    rows = [(i, "http://h.example/", plain(i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    exp = {i: "\n".join(f"part {i} {k} of the text that goes on for long enough to be most of the page" for k in range(2 + i % 4)) for i in range(12)}
    assert got == exp


def test_long_pages_have_a_template(spark):
    """Texts written down by hand; pages of more than PIVOT_BYTES, whose trees are sent or dealt."""
    long = "word " * 16_000
    rows = [(i, "http://l.example/", f"<html><body><article><p>Read our weekly letter</p><p>{long}{i}</p><p>End {i}</p></article></body></html>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    exp = {i: f"{long}{i}\nEnd {i}" for i in range(5)}
    assert {r["page_id"]: r["text"] for r in wrapper.extract(df).collect()} == exp


def test_trees_too_large_to_send_are_dealt(spark):
    rows = spark.range(60).selectExpr("id as page_id", "id as name", "cast(id % 3 as long) as lay")
    trees = spark.createDataFrame([(0, 20, "a"), (1, 20, "b")], "lay long, k long, pivot string")
    counts = spark.createDataFrame([(0, 20), (1, 20), (2, 20)], "lay long, k long")
    got = sorted(map(tuple, wrapper.beside_pivots(rows, trees, counts, 5000).select("page_id", "lay", "pivot").collect()))
    assert got == [(i, i % 3, "ab"[i % 3] if i % 3 < 2 else None) for i in range(60)]


def test_extraction_against_brute_force(spark):
    """Regions and constants anew: every page against the pivot by the plain matching, counted by hand."""
    rows = [(i, "http://b.example/", page(i, extra=f"<p>more {i}</p>" * (i % 3), notice="Note" if i % 5 else f"Rare {i}")) for i in range(20)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    names = {r["page_id"]: r["name"] for r in spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", F.xxhash64("html").alias("name")).collect()}
    pivot = wrapper.unpack(wrapper.pack(wrapper.parse(min(rows, key=lambda r: names[r[0]])[2])[1]))
    count = {}
    for _, _, h in rows:
        runs, root = wrapper.parse(h)
        for r, (slot, _) in zip(runs, wrapper.placed(runs, root, pivot)):
            count[slot, r.text] = count.get((slot, r.text), 0) + 1
    for i, _, h in rows:
        runs, root = wrapper.parse(h)
        own = [r.text for r, (slot, _) in zip(runs, wrapper.placed(runs, root, pivot)) if r.article and not r.dropped and not (slot >= 0 and count[slot, r.text] >= 16)]
        assert got[i] == "\n".join(own)
        assert "Note" not in own and (f"Rare {i}" in own) == (i % 5 == 0)
