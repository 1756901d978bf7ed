"""Hand-labelled pages the HTML model is trained on.

``data-main="1"`` marks an element and what is in it as main text, ``data-main="0"`` as anything else; the innermost mark
counts. The marks are read in training only.
"""

PAGES = (
    # an article page with menu, advert and footer
    """<html data-main="0"><head><title>A</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News
    </a></li></ul></nav><div class="ad">Buy now.</div><article data-main="1"><h1>Storm over the coast</h1><p>The storm
    reached the coast in the night and <b>broke</b> two bridges.</p><p>Yes.</p><p>Help came <a href="/x">from inland</a>
    at noon.<br>Roads stay shut.</p><ul><li>first item</li><li>second item</li></ul></article><footer>&copy; Example
    <p>All rights</p></footer></body></html>""",
    # header, aside, comments inside and around an article
    """<html data-main="0"><body><header class="site-header"><h1><a href="/">The Site</a></h1><p>Our motto</p></header>
    <main data-main="1"><article><header data-main="0"><p>By the desk, 3 May</p></header><h1>On bread</h1><p>Flour, water,
    salt and time make bread.</p><h2>Flour</h2><p>Use strong flour.</p><blockquote><p>Bread is life.</p></blockquote>
    <aside class="sidebar" data-main="0"><p>More on cakes</p></aside><div class="ad" data-main="0"><p>Best oven!</p></div>
    <table><tr><td>one</td><td>two</td></tr></table><section class="comments" data-main="0"><h3>Comments</h3>
    <div class="comment"><p>I liked this very much, thank you for writing it.</p></div></section><footer data-main="0">
    <p>Filed under food</p></footer></article></main><aside><h2>Related</h2><ul><li><a href="/1">One</a></li></ul></aside>
    <footer class="footer"><p>Contact us</p></footer></body></html>""",
    # notice, cookie banner, forms
    """<html data-main="0"><body><div class="notice"><p>We use cookies.</p><button>Accept</button></div><div
    id="cookie-banner" class="banner"><p>Cookies help us.</p></div><div id="content" class="content"
    data-main="1"><article><h1>Rivers</h1><p>Rivers run to the sea, and the sea is not full.</p><pre>code here</pre><figure>
    <img src="a.png"><figcaption>A river</figcaption></figure><form class="newsletter" data-main="0"><label>Mail</label>
    <input name="m"><button>Subscribe</button><p>Join our list</p></form><div class="notice" data-main="0">This page was
    moved.</div><p>They carry sand.</p></article></div><form class="search"><label>Search</label><input name="q">
    <select><option>All</option></select><textarea>text</textarea></form><div class="sidebar"><p>Popular posts</p></div>
    <div class="comments" id="comments"><p>First!</p><div class="comment"><p>Nice post and good pictures.</p></div></div>
    <div class="footer"><p>Imprint</p></div></body></html>""",
    # no article element: main or a content block holds the text
    """<html data-main="0"><body><div class="header"><a href="/">Logo</a></div><div class="menu nav"><a href="/1">One</a>
    <a href="/2">Two</a></div><main data-main="1"><h1>Hills</h1><p>Hills are low mountains.</p><p>Some are <i>steep</i>
    and some are <em>not</em>.</p><div><p>Sheep graze there.</p></div></main><div class="breadcrumbs"><a href="/">Home</a>
    </div><div class="related"><h3>See also</h3><p>Mountains</p></div><div class="share social"><span>Share</span></div>
    <div class="pagination"><a href="?2">Next</a></div></body></html>""",
    """<html data-main="0"><body><div id="header"><h1>Paper</h1></div><div class="post entry article" data-main="1"><h1>Ice
    </h1><p>Ice floats.</p><p>It is <strong>less dense</strong> than water.</p><ol><li>cold</li><li>hard</li></ol><dl><dt>
    ice</dt><dd>frozen water</dd></dl></div><div id="sidebar"><div class="widget"><p>Poll of the day</p></div></div><div
    class="advert sponsored promo"><p>A word from our sponsor</p></div><div id="footer"><p>Legal</p></div></body></html>""",
    """<html data-main="0"><body><div role="navigation"><ul><li><a href="/">Start</a></li></ul></div><div role="main"
    class="main text" data-main="1"><h2>Bees</h2><p>Bees dance to tell where flowers are.</p><p><span>They sleep.</span></p>
    </div><div role="complementary"><p>Weather: sunny</p></div><div role="banner"><p>Sale</p></div><div role="contentinfo">
    <p>Terms</p></div><div class="popup modal alert"><p>Sign in</p></div></body></html>""",
    # bare text
    """<html data-main="0"><head><title>t</title></head><body><h1 data-main="1">Notes</h1><p data-main="1">Plain pages have
    only text.</p><p data-main="1">And more of it.</p><ul data-main="1"><li>a</li></ul><div data-main="1"><p>Text in a bare
    block.</p></div></body></html>""",
    # sections in an article, a menu in an article
    """<html data-main="0"><body><nav class="menu"><p>Sections</p><a href="/s">Sport</a></nav><article data-main="1"
    class="post"><section><h2>One</h2><p>Text of one.</p></section><section><h2>Two</h2><p>Text of two.</p><div><p>Inner
    text.</p><div>Loose text</div></div></section><nav class="toc" data-main="0"><ul><li><a href="#1">One</a></li></ul></nav>
    <div class="related" data-main="0"><ul><li><a href="/r">Read this</a></li></ul></div><ul class="tags"
    data-main="0"><li><a href="/t">tag</a></li></ul><div class="ads advertisement" data-main="0"><span>Deal</span><a href="/d">
    go</a></div><p class="notice" data-main="0">Corrected on Monday.</p><p class="ad" data-main="0">Try it</p></article><section
    class="comments"><article class="comment"><p>A reader writes a long reply here.</p></article></section></body></html>""",
    # what an article holds that is not its text, told by the element alone
    """<html data-main="0"><body><main data-main="1"><article><header data-main="0"><p>3 May</p></header><h1>Wells</h1><p>Wells
    reach the ground water.</p><aside data-main="0"><h3>Aside</h3><p>More wells</p></aside><p>They run dry.</p><form
    data-main="0"><label>Mail</label><input><p>Write to us</p><button>Send</button></form><nav data-main="0"><ol><li><a
    href="#a">One</a></li></ol></nav><menu data-main="0"><li>Print</li></menu><dialog data-main="0"><p>Stay</p></dialog><p>
    Some are deep.</p><aside data-main="0"><p>Ask</p></aside><form data-main="0"><p>Vote</p><fieldset><legend>Poll</legend>
    <button>Yes</button></fieldset></form><nav data-main="0"><a href="/n">Next</a></nav><footer data-main="0"><p>Tags</p>
    </footer></article></main><aside><p>Ads</p></aside><form><p>Search</p><button>Go</button></form></body></html>""",
    """<html data-main="0"><body><article data-main="1"><h1>Dunes</h1><p>Dunes move with the wind.</p><aside data-main="0"><p>
    Sand</p><ul><li>x</li></ul></aside><form data-main="0"><p>Rate this</p><input></form><nav data-main="0"><p>Up</p></nav>
    <dialog data-main="0">Wait</dialog><menu data-main="0"><li>Share</li></menu><footer data-main="0"><p>By me</p></footer>
    <header data-main="0"><p>Kicker</p></header><p>Grass holds them.</p></article></body></html>""",
)
