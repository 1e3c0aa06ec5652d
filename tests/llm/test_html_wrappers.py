from tributary.llm import html_extract as H


def test_wrappers_of_the_article_stay():
    for wrap in ('<div class="content-sidebar-wrap">{}</div>', '<div class="no-sidebar">{}</div>', '<div class="header-fixed">{}</div>', '<form id="aspnetForm">{}</form>', '<form><div class="page has-sidebar">{}</div></form>'):
        inner = '<nav>m</nav><article><p>The text.</p><div class="share">x</div></article><div class="sidebar">Side</div><div id="comments"><article class="comment">A much longer comment of a reader</article></div>'
        assert H.main_text(f"<body>{wrap.format(inner)}</body>") == "The text.", wrap
        assert H.main_text(f"<body>{wrap.format('<main><p>The text.</p></main><p>Else</p>')}</body>") == "The text.", wrap
        inner = '<header>H</header><div class="story"><p>The text.</p></div><div class="sidebar">Side</div>'
        assert H.main_text(f"<body><div>a</div>{wrap.format(inner)}</body>").split("\n")[-1] == "The text.", wrap


def test_noise_stays_out():
    page = '<body><article><p>Text</p><form>Reply to this long text here</form></article><div class="no-sidebar"><article>Other long teaser</article></div></body>'
    assert H.main_text(page) == "Text"
    assert H.main_text('<body><div class="story">Text</div><div class="site-footer">Longer than text</div><form>Go</form></body>') == "Text"
    assert H.main_text('<body><div class="story">Text</div><div id="comments"><article>By a reader</article></div></body>') == "Text"
