"""Pages of many shapes with the main text that each must give."""

P1 = "The river rose again in spring, and the lower fields stood under water for a week."
P2 = "Farmers moved their cattle to the hills. Nobody was hurt, but three bridges were closed."
P3 = "By June the roads were dry and the first boats could be seen on the lake again."
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2020 The Valley Post</p></footer>"


def page(body: str, top: str = MENU, end: str = FOOT) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x:y}}</style></head><body>{top}{body}{end}</body></html>"


def paragraphs(*texts: str) -> str:
    return "".join(f"<p>{t}</p>" for t in texts)


ALL = "\n".join((P1, P2, P3))
TEXT = paragraphs(P1, P2, P3)

#: name: (html, text)
SHAPES: dict[str, tuple[str, str]] = {
    "plain article": (page(f"<article><h1>High water</h1>{TEXT}</article>"), "High water\n" + ALL),
    "main": (page(f"<main><h1>High water</h1>{TEXT}</main>"), "High water\n" + ALL),
    "named div": (page(f'<div class="post-content"><h2>High water</h2>{TEXT}</div>'), "High water\n" + ALL),
    "hashed classes": (page(f'<div class="css-1x9 kq"><div class="zrt"><h1>High water</h1>{TEXT}</div></div>'), "High water\n" + ALL),
    "nameless divs": (page(f"<div><div><h1>High water</h1>{TEXT}</div></div>"), "High water\n" + ALL),
    "nothing around": (page(f"<h1>High water</h1>{TEXT}"), "High water\n" + ALL),
    "bullet list": (page(f"<article><p>{P1}</p><ul><li>Fields under water</li><li>Three bridges closed</li><li>Cattle on the hills</li></ul><p>{P3}</p></article>"), f"{P1}\nFields under water\nThree bridges closed\nCattle on the hills\n{P3}"),
    "numbered list": (page(f"<main><p>{P1}</p><ol><li>{P2}</li><li>{P3}</li></ol></main>"), ALL),
    "list of links": (page(f'<article>{TEXT}<h2>Sources</h2><ul><li><a href="/a">Report of the water office</a></li><li><a href="/b">Map of the lower fields</a></li></ul></article>'), f"{ALL}\nSources\nReport of the water office\nMap of the lower fields"),
    "table": (page(f"<article><p>{P1}</p><table><tr><th>Village</th><th>Level</th></tr><tr><td>Upper mill</td><td>3 m</td></tr></table><p>{P2}</p></article>"), f"{P1}\nVillage\nLevel\nUpper mill\n3 m\n{P2}"),
    "code": (page(f"<article><p>{P1}</p><pre><code>for x in levels:\n  print(x)</code></pre><p>{P2}</p></article>"), f"{P1}\nfor x in levels: print(x)\n{P2}"),
    "quotation": (page(f"<article><p>{P1}</p><blockquote>{P2}</blockquote><p>{P3}</p></article>"), ALL),
    "quotation with paragraph": (page(f'<div class="entry"><p>{P1}</p><blockquote><p>{P2}</p></blockquote><p>{P3}</p></div>'), ALL),
    "figure": (page(f'<article><p>{P1}</p><figure><img src="x.png" alt="no"><figcaption>The mill in April</figcaption></figure><p>{P2}</p></article>'), f"{P1}\nThe mill in April\n{P2}"),
    "definitions": (page(f"<main><p>{P1}</p><dl><dt>Weir</dt><dd>A low dam across a river.</dd></dl><p>{P2}</p></main>"), f"{P1}\nWeir\nA low dam across a river.\n{P2}"),
    "bare text": (page(f"<article><div>{P1}</div><div>{P2}</div>{P3}</article>"), ALL),
    "references": (page("<article><p>Rain &amp; snow &ndash; 5&nbsp;&lt;&nbsp;6 said the mill&#39;s owner, who has kept the record for years.</p><p>It   is\n so.</p></article>"), "Rain & snow – 5 < 6 said the mill's owner, who has kept the record for years.\nIt is so."),
    "cookie notice": (page(f"<article>{TEXT}</article>", top='<div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept all</button></div>' + MENU), ALL),
    "consent by another name": (page(f"<article>{TEXT}</article>", top='<div class="gdpr"><p>We value your privacy</p><p>Manage settings</p></div>' + MENU), ALL),
    "comments": (page(f'<article>{TEXT}</article><section class="comments"><h3>Comments</h3><div class="comment"><p>I saw it from the old bridge, it was a sight.</p></div><div class="comment"><p>Nice post</p></div></section>'), ALL),
    "comments by another name": (page(f'<article>{TEXT}</article><div id="disqus_thread"><p>I saw it from the old bridge, it was a sight.</p><p>So did we.</p></div>'), ALL),
    "comment list": (page(f'<main>{TEXT}</main><ol class="commentlist"><li>I saw it from the old bridge, it was a sight.</li><li>So did we.</li></ol>'), ALL),
    "comments inside the article": (page(f'<article>{TEXT}<div class="replies"><p>I saw it from the old bridge, it was a sight.</p></div></article>'), ALL),
    "advert inside": (page(f'<article><p>{P1}</p><div class="ad">Buy two boats, get one free.</div><p>{P2}</p><p>{P3}</p></article>'), ALL),
    "promo box inside": (page(f'<article><p>{P1}</p><div class="promo-box"><p>Buy two boats, get one free.</p></div><p>{P2}</p><p>{P3}</p></article>'), ALL),
    "sidebar": (page(f'<div class="row"><main>{TEXT}</main><aside class="sidebar"><h3>Popular</h3><ul><li><a href="/1">Ten old mills</a></li><li><a href="/2">Boats for sale</a></li></ul></aside></div>'), ALL),
    "newsletter form": (page(f'<article><p>{P1}</p><p>{P2}</p><form class="newsletter"><label>Subscribe to our newsletter</label><input name="e"><button>Send</button></form><p>{P3}</p></article>'), ALL),
    "search form": (page(f"<main>{TEXT}</main>", top='<header><div class="logo">The Valley Post</div><form><label>Search</label><button>Search</button></form></header>' + MENU), ALL),
    "menus of divs": (page(f'<div class="content">{TEXT}</div>', top='<div class="menu"><a href="/">Home</a><a href="/n">News</a></div><div class="breadcrumb"><a href="/">Home</a> / <a href="/n">News</a></div>', end='<div class="footer">Imprint</div>'), ALL),
    "related and share": (page(f'<article>{TEXT}</article><div class="share"><a href="/s">Share</a><a href="/t">Tweet</a></div><div class="related"><h3>Related</h3><ul><li><a href="/1">Ten old mills</a></li></ul></div>'), ALL),
    "scripts and styles": (page(f"<article><script>var a='</p>';</script><p>{P1}</p><style>p{{}}</style><p>{P2}</p><noscript>Turn it on</noscript><p>{P3}</p></article>"), ALL),
    "very long": ("<article>" + "<p>word word</p>" * 20_000 + "</article>", "\n".join(["word word"] * 20_000)),
    "long and real": (page(f"<article>{TEXT * 300}</article>"), "\n".join([ALL] * 300)),
}
