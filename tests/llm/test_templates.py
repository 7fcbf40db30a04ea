"""Template removal: what every article carries, hosts of any size, classes around the article."""

from stipple.llm import templates

SCHEMA = "page_id long, url string, html string"


def texts(spark, pages, **kw):
    got = templates.main_text(spark.createDataFrame(pages, SCHEMA), **kw).collect()
    return {r["page_id"]: r["text"] for r in got}


def test_template_inside_articles_goes_and_copies_of_an_article_stay(spark):
    page = "<body><nav>Menu</nav><main><div><article><h1>{0}</h1><p>Story {0}<ul><li>Mail<li>Print</ul><p>Join our list</p></article></div><p>{1}</p></main></body>"
    pages = [(k, f"http://h.example/{k}", page.format(f"Title {k}", f"More {k}")) for k in range(12)]
    copies = [(100 + k, f"http://h.example/c{k}", page.format("Copy", f"Beside {k}").replace("Join our list", "Own end")) for k in range(8)]
    got = texts(spark, pages + copies)
    assert all(got[k] == f"Title {k}\nStory Title {k}\nMore {k}" for k in range(12))
    assert all(got[100 + k] == f"Copy\nStory Copy\nOwn end\nBeside {k}" for k in range(8))


def test_threshold_does_not_grow_with_the_host(spark):
    block = "<div><p>Author of these</p></div>"
    pages = [(k, "http://h.example/x", f"<body>{block if k < 6 else ''}<p>Text {k}</p></body>") for k in range(400)]
    pages += [(1000 + k, "http://other.example/x", f"<body>{block}<p>Text {k}</p></body>") for k in range(4)] + [(3, "http://h.example/x", pages[3][2])]
    sent, joined = texts(spark, pages), texts(spark, pages, max_sent=0)
    assert sent == joined
    assert all(sent[k] == f"Text {k}" for k in range(400)) and all(sent[1000 + k] == f"Author of these\nText {k}" for k in range(4))


def test_classes_around_the_article_do_not_drop_it(spark):
    story = "<h1>Head</h1><p>The whole story of the page, told at length</p>"
    names = ["with-sidebar", "no-sidebar", "content widget-area", "page-search-result", "layout-nav-left", "sidebar"]
    pages = [(k, f"http://h{k}.example/", f'<body><div class="{n}"><article>{story}</article><div class="related"><article>Other</article></div></div></body>')
             for k, n in enumerate(names)]
    pages += [(10 + k, f"http://g{k}.example/", f'<body><div class="{n}">{story}</div><div class="sidebar-left">Links</div></body>') for k, n in enumerate(names[:5])]
    pages += [(20, "http://i.example/", f'<body><article><div class="no-sidebar">{story}</div></article></body>'),
              (21, "http://j.example/", f'<body><article>{story}<div class="comment-list">{"<p>I say</p>" * 40}</div></article><div class="widget-area">{"Much " * 90}</div></body>')]
    got = texts(spark, pages)
    assert set(got.values()) == {"Head\nThe whole story of the page, told at length"}
