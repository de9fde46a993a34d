from __future__ import annotations

import random

import pytest
import xxhash

from matchlake.llm import html_wrapper as H

CASES = {
    "<article><h1>A &amp; b</h1><p>One\n two<p>three <b>x</b>&nbsp;y</article><footer>f</footer>": "A & b\n\nOne two\n\nthree x y",
    "<nav><a>m</a></nav><article>t<div class='ad'>buy</div>u</article>": "t\n\nu",
    "<script>var t='</p>';</script><body><main><p>a<br>b</p><aside>s</aside></main><form>q</form></body>": "a b",
    "<article><p>x</p><section id=comments><article class=comment>no</article></section></article>": "x",
    "<article><header><h1>T</h1></header><p>x</p></article>": "T\n\nx",
    "<header>site</header><div>x<!-- <p>no -->y</div>": "xy",
    "<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>": "a\n\nb\n\nc\n\nd",
    "<article>a<script>never ends": "a",
    "<article>a<p title='x > y'>b</p></article": "a\n\nb",
    "plain &lt;text&gt;": "plain <text>",
    "<p>1 < 2 and 3": "1 < 2 and 3",
    "": "",
    "<head><title>t</title></head>": "",
    "<div class='cookie-notice'>c</div><div class=content><p>x</p></div>": "x",
    "<article><p>a</p><div hidden>h</div><p>b</b></p></div></article>": "a\n\nb",
}


@pytest.mark.parametrize("page", CASES)
def test_blocks(page):
    assert H.extract(page, None) == CASES[page]


def test_deep_and_long_pages():
    assert H.extract("<div>" * 5000 + "x", None) == "x"
    assert len(H.extract("<article>" + "<p>word</p>" * 50_000 + "</article>", None)) == 6 * 50_000 - 2


def test_matching_is_largest():
    a, b = H.parse("<ul><li>1</li><p>2</p><li>3</li></ul>"), H.parse("<ul><li>x</li><li>y</li><b></b></ul>")
    assert len(H.matching(a, b)) == 4


def test_wrapper_separates_template_from_content(spark):
    page = lambda i, body: f"<body><div class=top>Site {i}</div><div class=page><div class=story><p>Read our daily news here</p><p>{body}</p><p>more {body}</p></div><div class=box>x{i}</div></div><p>imprint</p></body>"
    rows = [(i, f"http://h.io/{i}", page(i, f"story number {i} " * 20)) for i in range(12)] + [(90, "http://one.io/", "<p>alone</p>"), (91, None, None), (92, "http://h.io/x", "<b>other</b>"), (90, "http://one.io/", "<p>alone</p>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.main_text(df).collect()}
    for i in range(12):
        body = (f"story number {i} " * 20).strip()
        assert got[i] == (f"{body}\n\nmore {body}", 2 * len(body) + 7)
    assert got[90] == ("alone", 5) and got[91] == ("", 0) and got[92] == ("other", 5)
    assert H.main_text(df).count() == len(rows)


def test_deep_pages_have_no_wrapper():
    assert H.induce(["<div>" * 3000 + "x"] * 3 + ["<p>" * 3] * 2)["template"] == []


def test_empty_table(spark):
    assert H.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def texts(spark, rows):
    got = H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    return {r["page_id"]: r["text"] for r in got}


def test_each_layout_has_its_wrapper(spark):
    one = lambda i: f"<body><div class=story><p>Read our daily news</p><p>{f'tale {i} ' * 9}</p></div><div class=box>b{i}</div></body>"
    two = lambda i: f"<body><div class=board><p>Top of the table</p><p>{f'score {i} ' * 9}</p></div></body>"
    got = texts(spark, [(i, f"http://h.io/{i}", (one if i % 2 else two)(i)) for i in range(12)])
    assert got == {i: ((f"tale {i} " if i % 2 else f"score {i} ") * 9).strip() for i in range(12)}


def test_small_hosts_and_large_trees_have_a_template(spark):
    few = [(i, f"http://few.io/{i}", f"<body><p>Same imprint</p><p>{f'tale {i} ' * 9}</p></body>") for i in range(3)]
    long = [(i, f"http://long.io/{i}", f"<body><div><p>Same start</p></div>{''.join(f'<div><p>w{i}x{k}</p></div>' for k in range(1600 + i))}<div><p>Same end</p></div></body>") for i in range(10, 15)]
    got = texts(spark, few + long)
    assert all(got[i] == (f"tale {i} " * 9).strip() for i in range(3))
    assert all(got[i].split("\n\n") == [f"w{i}x{k}" for k in range(1600 + i)] for i in range(10, 15))


def test_all_pages_settle_the_template(spark):
    """A line that three of 150 pages lack is no template; no sample of a few pages shows it."""
    got = texts(spark, [(i, f"http://h.io/{i}", f"<body><p>{'Nearly' if i % 50 else 'Other'} the same</p><p>Same</p><p>{f'tale {i} ' * 9}</p></body>") for i in range(150)])
    assert all(got[i] == f"{'Nearly' if i % 50 else 'Other'} the same\n\n" + (f"tale {i} " * 9).strip() for i in range(150))


def test_large_trees_are_aligned_in_order():
    a, b = (H.Outline(*H.blocks(H.parse("<div><p>h</p></div>" + "<ul><li>x</ul>" * n + "<div><p>f</p></div>"))) for n in (300, 200))
    to = [j for j in H.aligned(a, b) if j >= 0]
    assert len(to) == len(b.names) and to == sorted(to)


def made_tree(rng, n, tags, deep):
    """Parents and tags of n elements in page order."""
    above, path = [-1], [0]
    for k in range(1, n):
        while len(path) > 1 and rng.random() > deep:
            path.pop()
        above.append(path[-1])
        path.append(k)
    return above, ["", *(rng.choice(tags) for _ in range(n - 1))]


def changed_tree(rng, above, tags, names):
    """The tree with some elements left out with all below, added or renamed."""
    place, out, named = {0: 0}, [-1], [""]
    for k in range(1, len(above)):
        if above[k] in place and rng.random() > 0.03:
            if rng.random() < 0.05:
                out.append(place[above[k]])
                named.append(rng.choice(names))
            place[k] = len(out)
            out.append(place[above[k]])
            named.append(tags[k] if rng.random() < 0.97 else rng.choice(names))
    return out, named


def plainly_aligned(a, b):
    """Simple tree matching by its recursion over all pairs of children; of several largest ones that which pairs later children."""
    kids = [[[c for c in range(1, len(above)) if above[c] == k] for k in range(len(above))] for above, _ in (a, b)]
    memo = {}

    def table(x, y):
        if (x, y) not in memo:
            rows = [[0] * (len(kids[1][y]) + 1)]
            for c in kids[0][x]:
                row = [0]
                for j, d in enumerate(kids[1][y]):
                    row.append(max(row[j], rows[-1][j + 1], rows[-1][j] + size(c, d)))
                rows.append(row)
            memo[(x, y)] = rows
        return memo[(x, y)]

    def size(x, y):
        return 1 + table(x, y)[-1][-1] if a[1][x] == b[1][y] else 0

    to, todo = [-1] * len(a[0]), [(0, 0)]
    while todo:
        x, y = todo.pop()
        to[x] = y
        rows, i, j = table(x, y), len(kids[0][x]), len(kids[1][y])
        while i and j:
            c, d = kids[0][x][i - 1], kids[1][y][j - 1]
            if size(c, d) and rows[i][j] == rows[i - 1][j - 1] + size(c, d):
                todo.append((c, d))
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return to


@pytest.mark.parametrize(("kept", "table"), [(8_000_000, 2_000_000), (0, 1), (100, 30)])
def test_trees_of_all_sizes_are_matched_whole(monkeypatch, kept, table):
    """Small trees, those of hundreds of elements and deep ones equal the recursion, also where little of it may be kept."""
    monkeypatch.setattr(H, "KEPT", kept)
    monkeypatch.setattr(H, "TABLE", table)
    rng = random.Random(11)
    large = 0
    for n, names, deep in [(k, "abcd"[: 1 + k % 4], d) for k in (1, 2, 5, 20, 60) for d in (0.2, 0.5, 0.8) for _ in range(6)] + [(400, "abc", 0.3), (400, "ab", 0.45), (300, "abcd", 0.1), (250, "ab", 0.995)]:
        a = made_tree(rng, n, names, deep)
        for b in (changed_tree(rng, *a, names), made_tree(rng, rng.randint(1, n + 5), names, deep)):
            for x, y in ((a, b), (b, a)):
                assert H.aligned(H.Outline(*x, []), H.Outline(*y, [])) == plainly_aligned(x, y)
                large += len(x[0]) * len(y[0]) > 10_000
    assert large > 8


@pytest.mark.parametrize("more", ["<section></section>" * 150, "<section></section>" * 3000, "<section>" * 200 + "</section>" * 200])
def test_a_page_s_size_changes_no_text(spark, more):
    """A line whose elements have classes of their own on each page is template beside few elements, beside many and beside deep ones."""
    page = lambda i, more: f"<body><div class=n{i}><p class=p{i}>Subscribe today</p></div>{more}<p>{f'tale {i} ' * 9}</p></body>"
    few = texts(spark, [(i, f"http://h.io/{i}", page(i, "")) for i in range(8)])
    assert few == {i: (f"tale {i} " * 9).strip() for i in range(8)}
    assert texts(spark, [(i, f"http://h.io/{i}", page(i, more)) for i in range(8)]) == few


def test_pages_beside_long_ones_of_their_layout(spark):
    """Long and short pages of one host are matched alike: the line is template on all."""
    page = lambda i, more: f"<body><div class=n{i}><p class=p{i}>Subscribe today</p></div>{'<ul><li></li></ul>' * more}<p>{f'tale {i} ' * 9}</p></body>"
    got = texts(spark, [(i, f"http://h.io/{i}", page(i, 10 ** (i % 4))) for i in range(12)])
    assert got == {i: (f"tale {i} " * 9).strip() for i in range(12)}


def test_template_decides_inside_articles(spark):
    page = lambda i: f"<article><h1>T{i}</h1><div class=lead><p>Support our paper</p></div><p>{f'tale {i} ' * 9}</p>{'<p>A saying</p>' if i else ''}<p>Support our paper</p></article>"
    copy = lambda i: f"<article><h1>One text</h1><p>{'a long text ' * 9}</p><p>seen {i}</p></article>"
    got = texts(spark, [(i, f"http://h.io/{i}", page(i)) for i in range(8)] + [(i, f"http://copies.io/{i}", copy(i)) for i in range(10, 18)])
    assert all(got[i] == "\n\n".join([f"T{i}", (f"tale {i} " * 9).strip(), *["A saying"][: i > 0]]) for i in range(8))
    assert all(got[i] == f"One text\n\n{('a long text ' * 9).strip()}\n\nseen {i}" for i in range(10, 18))


class Plain:
    """A page of elements with tags that are unique under their parent: its blocks as (path of tags, text), and its html."""

    def __init__(self, rng, host, kind):
        self.host, self.kind, self.found = host, kind, []
        word = lambda: f"tale {rng.randrange(10**6)} " * rng.randint(1, 9)
        line = lambda path: f"Line of {'-'.join(path)}" if rng.random() < 0.9 else word()
        body, top = "", "article" if host == "art.io" else "xm"
        for tag in ["xa", top, "xz"]:
            if tag != top and rng.random() < 0.2:
                continue
            inner = ""
            for child in ("ya", "yb", "yc", "yd"):
                if rng.random() < 0.85:
                    text = (word() if tag == top and child != "ya" else line((tag, child))).strip()
                    self.found.append(((tag, child), text))
                    inner += f"<{child}>{text}</{child}>"
            body += f"<{tag}{f' class={kind}' if tag == top else ''}>{inner}</{tag}>"
        self.html = body
        self.doc = int.from_bytes(xxhash.xxh64(body.encode(), seed=42).digest(), "big", signed=True)

    def paths(self):
        return {p[:k] for p, _ in self.found for k in range(3)} | ({("article",)} if "<article" in self.html else set()) | ({("xm",)} if "<xm" in self.html else set()) | {(t,) for t in ("xa", "xz") if f"<{t}>" in self.html}


def by_definition(pages):
    """The main text of each page: groups, templates and containers as the module states them, with paths of tags for the alignment."""
    layouts = {}
    for p in pages:
        layouts.setdefault((p.host, p.kind), []).append(p)
    grouped = {}
    for (host, kind), some in layouts.items():
        many = len({p.doc for p in some}) > 1
        grouped.setdefault((host, kind if many else None), []).extend(some)
    out = {}
    for (_, kind), some in grouped.items():
        if kind is None and len({p.kind for p in some}) == 1:
            template, container = set(), ()
        else:
            template, container = wrapper_by_definition(some)
        for p in some:
            article = any(path[0] == "article" for path, _ in p.found)
            kept = [(a, t) for a, t in p.found if not article or a[0] == "article"]
            if not article:
                kept = [(a, t) for a, t in kept if a[: len(container)] == container] or kept
            out[id(p)] = "\n\n".join(t for a, t in kept if (a, t) not in template)
    return out


def wrapper_by_definition(some):
    first = min(some, key=lambda p: p.doc)
    known, sizes, constant = first.paths(), {}, {}
    for p in some:
        for path, text in p.found:
            while path not in known:
                path = path[:-1]
            sizes[path] = sizes.get(path, 0) + len(text)
    for path, text in first.found:
        having = [p for p in some if any(a == path for a, _ in p.found)]
        if len({p.doc for p in having}) > 1 and all((path, text) in p.found for p in having):
            constant[(path, text)] = (len(text) * len(having), min(H.ENOUGH, len({p.doc for p in having})))
    inside = lambda a: a[:1] == ("article",)
    varies = 2 * sum(n for n, _ in constant.values()) <= sum(sizes.values())
    article = 2 * sum(n for (a, _), (n, _) in constant.items() if inside(a)) <= sum(n for a, n in sizes.items() if inside(a))
    template = {i for i, (_, n) in constant.items() if (varies or n >= H.ENOUGH) and (article or not inside(i[0]))}
    for path, text in template:
        sizes[path] -= constant[(path, text)][0]
    total, container = sum(sizes.values()), ()
    under = lambda a: sum(n for b, n in sizes.items() if b[: len(a)] == a)
    while total > 0 and (below := [a for a in known if len(a) == len(container) + 1 and a[: len(container)] == container]):
        best = max(below, key=under)
        if under(best) < H.SHARE * total:
            break
        container = best
    return template, container


@pytest.mark.parametrize(("small", "part"), [(5000, 4096), (1, 4096), (1, 2)])
def test_query_equals_its_definition(spark, tmp_path, monkeypatch, small, part):
    """Hosts of many pages, of layouts of their own and of one page; also where groups are dealt out, in one share or several."""
    from matchlake.llm import queries

    monkeypatch.setattr(H, "SMALL", small)
    monkeypatch.setattr(H, "PART", part)
    rng = random.Random(8)
    pages = [Plain(rng, h, k) for h, kinds, n in (("a.io", "pq", 9), ("art.io", "pq", 7), ("own.io", "pqrst", 1), ("few.io", "pq", 2), ("mix.io", "p", 6), ("mix.io", "q", 1), ("mix.io", "r", 1)) for k in kinds for _ in range(n)]
    pages += [Plain(rng, f"one{k}.io", "p") for k in range(4)] + pages[:3]
    want = by_definition(pages)
    rows = [(k, f"http://{p.host}/{k}", p.html, "clash") for k, p in enumerate(pages)] + [(900, "http://a.io/none", None, "clash"), (901, None, "", None), (None, "http://a.io/", pages[0].html, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, layout string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op6_html_wrapper(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts_ = {r["page_id"]: r["text"] for r in got}
    assert texts_[900] == texts_[901] == ""
    wrong = [k for k, p in enumerate(pages) if texts_[k] != want[id(p)]]
    assert not wrong, (len(wrong), texts_[wrong[0]], want[id(pages[wrong[0]])], pages[wrong[0]].html)
    assert sum(want[id(p)] != "\n\n".join(t for _, t in p.found) for p in pages) > 20
