"""Small labelled pages: content stands between the comments [ and ].

They teach the weights of layouts that a crawl's own pages may not show. All of them
were written for this file.
"""

OPEN, CLOSE = "<!--[-->", "<!--]-->"

LABELLED_PAGES = (
    # A page of plain blocks without article or main.
    """<html><body><div id="top"><a href="/">Home</a> <a href="/news">News</a> <a href="/mail">Contact us</a></div>
<div class="page"><!--[--><h1>How the mill was built</h1><p>The mill stands where the two rivers meet, and for most of
its life it ground the wheat of four villages, one after the other, in the order in which their carts came.</p>
<p>In the third year a flood took the wheel. The miller, who had <a href="/seen">seen it coming</a>, had lifted the
stones the day before, and so the mill could work again within a week of the water going down.</p>
<p>Nobody knows who drew the plan.</p><!--]--></div><div>Next: <a href="/b">The bridge</a> | <a href="/c">The ford</a>
| <a href="/d">The inn</a></div><div>All texts by the village. <a href="/imprint">Imprint</a></div></body></html>""",
    # Tables as layout.
    """<body><table><tr><td><a href="/1">One</a><br><a href="/2">Two</a><br><a href="/3">Three</a></td><td><!--[-->
<h2>Baking with rye</h2>Rye dough needs more water than wheat dough, and it should rest for longer, since it takes up
water slowly.<br><br>Give it a night in a cool room. In the morning the surface shows small cracks, and a finger leaves
a mark that comes back only in part.<!--]--></td></tr><tr><td><a href="/map">Map</a></td><td><a href="/old">Older</a>
<a href="/new">Newer</a></td></tr></table></body>""",
    # A list within the content, menus as lists around it.
    """<body><ul><li><a href="/a">Start</a></li><li><a href="/b">Shop</a></li><li><a href="/c">Account</a></li></ul>
<div><!--[--><h1>Five rules for walking at night</h1><p>Most paths are easier in the dark than people think, as long as
they keep to a few habits that cost nothing.</p><ul><li>Let your eyes rest for a quarter of an hour before you set
out, and keep lamps away from them.</li><li>Walk in the middle of the path, where roots are fewest.</li><li>Say aloud
what you see, so that those behind you know of it.</li></ul><p>None of this replaces a good map.</p><!--]--></div>
<ul><li><a href="/x">Terms</a></li><li><a href="/y">Privacy</a></li></ul></body>""",
    # An article with things around and a note before it.
    """<body><div><a href="/">The Daily Sheet</a></div><div>You have two free texts left this month.</div><article><!--[-->
<h1>Harbour opens again</h1><p>After two winters of work the small harbour was opened on Sunday. The first boat in was
a ferry that had waited outside since dawn.</p><blockquote>We could have waited another hour, said its captain.
</blockquote><p>The pier is now forty metres longer.</p><!--]--></article><div>More from the coast: <a href="/1">Fish
prices fall</a> <a href="/2">New lighthouse keeper</a></div><p>Write to us about this text.</p></body>""",
    # Main without article; short paragraphs.
    """<body><div><a href="/in">Sign in</a></div><main><!--[--><h1>Release notes</h1><h2>Speed</h2><p>Start-up takes half
as long.</p><h2>Mends</h2><p>The list no longer jumps when a row is taken out. Dates are shown in the order of the
reader's country.</p><pre>run --fast</pre><!--]--></main><div><a href="/all">All releases</a></div></body>""",
    # Paragraphs as blocks of their own, some of them short.
    """<body><div><div><a href="/">Top</a></div><div><a href="/list">List</a></div></div><div id="c"><!--[--><div>The bell
on the hill</div><div><div>Every evening at seven somebody rings the bell on the hill, and nobody in the valley has ever
found out who it is.</div><div>It rings nine times.</div><div>On the night of the great storm it rang as well, although
the rope had been taken down the week before to be mended by the saddler.</div><div>He swore to it.</div><div><div>Some
say that the wind does it, but then the wind has learnt to count.</div><div>Listen tonight.</div></div></div><!--]-->
</div><div><div><a href="/p">Previous</a></div><div><a href="/n">Next</a></div></div></body>""",
)
