"""Labelled pages for training the block model: page layouts in which every block of the main text is marked.

A layout is HTML in which {s} stands for a short phrase, {t} for a sentence, {p} for a paragraph of sentences; MARK begins
each block that belongs to the main text. The words put in are invented, so that only the shape of a text is learnt.
"""

from __future__ import annotations

import random

MARK = "§"

# Layouts by common habit of web pages.
LAYOUTS = (
    '<html><head><title>{s}</title></head><body><nav><ul><li><a href="/">{s}</a></li><li><a href="/a">{s}</a></li><li><a href="/b">{s}</a></li></ul></nav><div class="ad">{t}</div>'
    '<article><h1>§{s}</h1><p>§{p}</p><p>§{t}</p><p>§{s}</p><h2>§{s}</h2><p><b>§{p}</b></p><p>§{p}</p></article><footer>&copy; {s} &middot; {t}</footer></body></html>',
    '<body><header class="site-header"><a href="/">{s}</a><p>{s}</p></header><main><h1>§{t}</h1><p>§{p}</p><ul><li>§{s}</li><li>§{t}</li></ul><p>§{p}</p><blockquote>§{t}</blockquote></main>'
    '<aside class="sidebar"><h3>Related</h3><ul><li><a href="#">{t}</a></li><li><a href="#">{s}</a></li></ul><p>{t}</p></aside><footer><p>Copyright {s}. All rights reserved.</p></footer></body>',
    '<body><div id="menu"><a href="#">{s}</a> <a href="#">{s}</a></div><div class="cookie-notice"><p>This site uses cookies. {t}</p><button>OK</button></div><div id="content"><h1>§{s}</h1><p>§{p}</p>'
    '<div class="advert">{t}</div><p>§{p}</p><p>§{t}</p></div><div id="comments"><h3>3 comments</h3><div class="comment"><p>{t}</p></div><div class="comment"><p>{p}</p></div></div><div id="footer">{s}</div></body>',
    '<body><div class="header"><h2><a href="/">{s}</a></h2></div><div class="post"><h1 class="title">§{t}</h1><div class="entry-content"><p>§{p}</p><p>§{t}</p><h3>§{s}</h3><p>§{p}</p></div>'
    '<div class="share social"><a href="#">Share</a> <a href="#">{s}</a></div></div><div class="related-posts"><p><a href="#">{t}</a></p></div><section class="comments"><p>{p}</p><p>{t}</p><form><p>{s}</p><label>{s}</label></form></section></body>',
    '<body><div role="banner">{s}</div><div class="breadcrumb"><a href="#">{s}</a> / <a href="#">{s}</a></div><div class="article-body"><h1>§{s}</h1><p>§{p}</p><table><tr><td>§{s}</td><td>§{s}</td></tr><tr><td>§{s}</td><td>§{t}</td></tr></table>'
    '<p>§{p}</p></div><div class="newsletter promo"><h4>Newsletter</h4><p>Subscribe: {t}</p><form><p>{s}</p></form></div><div class="footer"><ul><li><a href="#">{s}</a></li><li>{s}</li></ul></div></body>',
    '<body><div class="banner notice" role="alert"><p>{t}</p></div><nav class="navbar"><a href="#">{s}</a></nav><article class="story"><header><h1>§{t}</h1></header><p>§{p}</p><aside class="ad sponsored"><p>{t}</p></aside><p>§{p}</p>'
    '<figure><figcaption>§{s}</figcaption></figure><p>§{t}</p><footer><a href="#">{s}</a> {s}</footer></article><section id="comments"><article class="comment"><p>{p}</p></article><article class="comment"><p>{t}</p></article></section><footer>{t}</footer></body>',
    '<body><table class="layout"><tr><td class="menu"><a href="#">{s}</a></td><td><h1>§{s}</h1><p>§{p}</p><p>§{p}</p><p>§{t}</p></td><td class="sidebar"><p>{t}</p></td></tr></table><p class="copyright">Copyright {s}</p></body>',
    '<body><h1>§{s}</h1><p>§{p}</p><p>§{t}</p><pre>§{t}</pre><p>§{p}</p><hr><p class="footer"><a href="#">{s}</a></p></body>',
    '<body><div class="login form"><form action="/"><p>{t}</p><label>{s}</label></form></div><main class="content"><section><h2>§{s}</h2><p>§{p}</p><ol><li>§{t}</li><li>§{p}</li></ol></section><section><h2>§{s}</h2><p>§{t}</p></section>'
    '<div class="ads"><p>{p}</p></div></main><div class="widget"><p>{t}</p></div><footer class="site-footer"><p>{t}</p><p>{s}</p></footer></body>',
    '<body><div class="popup modal"><p>{t}</p></div><header><nav><a href="#">{s}</a><a href="#">{s}</a></nav></header><article><h1>§{s}</h1><p>§{t}</p></article><div class="disclaimer"><p>{p}</p></div><footer><p>{p}</p></footer></body>',
    '<body><div class="top-bar">{s}</div><div id="main"><div class="text">§{p}</div><div class="text">§{p}</div><div class="text">§{t}</div><div class="banner">{t}</div></div><div id="sidebar"><div>{p}</div><div><a href="#">{s}</a></div></div><div id="bottom">{s}</div></body>',
    '<body><article><p>§{p}<p>§{t}<p>§{p}<p>§{s}</article><section class="discussion"><h3>Replies</h3><ul><li>{t}</li><li>{p}</li></ul></section><aside><p>{p}</p></aside></body>',
    # Reader comments inside the article, under several names; a page of plain paragraphs under names that say nothing.
    '<body><nav><a href="/">{s}</a></nav><article><h1>§{s}</h1><p>§{p}</p><p>§{t}</p><p>§{p}</p><div class="replies"><h3>{s}</h3><div><p>{t}</p></div><div><p>{p}</p></div></div></article><footer><p>{s}</p></footer></body>',
    '<body><article><header><h1>§{t}</h1></header><p>§{p}</p><p>§{p}</p><section class="responses"><h2>Responses</h2><p>{p}</p><p>{t}</p></section></article><footer>{s}</footer></body>',
    '<body><main><h1>§{s}</h1><p>§{p}</p><p>§{p}</p><div id="disqus" class="feedback reactions"><ul><li><p>{t}</p></li><li><p>{p}</p></li></ul></div></main><footer>{s}</footer></body>',
    '<body><div class="qa"><a href="/">{s}</a> <a href="#">{s}</a> <a href="#">{s}</a></div><div class="qb"><p>§{p}</p><p>§{t}</p><p>§{p}</p><p>§{p}</p></div><div class="qc">&copy; {s} <a href="#">{s}</a></div></body>',
    '<body><div class="ga"><div class="gb"><a href="#">{s}</a><a href="#">{s}</a></div></div><div class="gc"><div class="gd"><h2>§{s}</h2><div>§{p}</div><div>§{t}</div><div>§{p}</div></div></div></body>',
    '<body><div id="logo"><a href="#">{s}</a></div><div id="bodycontent"><h1>§{s}</h1><p>§{p}</p><div id="toc"><ul><li><a href="#">{s}</a></li><li><a href="#">{s}</a></li></ul></div><h2>§{s}</h2><p>§{p}</p><ul><li>§{t}</li><li>§{s}</li></ul></div><div id="catlinks"><a href="#">{s}</a></div></body>',
    '<body><center><a href="#">{s}</a> | <a href="#">{s}</a></center><h2>§{s}</h2><p>§{p}<p>§{p}<blockquote>§{p}</blockquote><p>§{t}<hr><address><a href="#">{s}</a> {s}</address></body>',
)


def labelled_pages(count: int = 380, seed: int = 11) -> list[str]:
    """count pages: the layouts in turn, filled with invented words."""
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprstvw" for b in ("a", "e", "i", "o", "u", "an", "er", "is")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    phrase = lambda low, high: " ".join(word() for _ in range(rng.randint(low, high)))
    sentence = lambda: phrase(4, 16).capitalize() + rng.choice("....!?")
    fill = {"{s}": lambda: phrase(1, 4).capitalize(), "{t}": sentence, "{p}": lambda: " ".join(sentence() for _ in range(rng.randint(2, 8)))}
    pages = []
    for i in range(count):
        page = LAYOUTS[i % len(LAYOUTS)]
        for key, make in fill.items():
            while key in page:
                page = page.replace(key, make(), 1)
        pages.append(page)
    return pages
