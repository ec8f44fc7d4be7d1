"""Labelled pages for the HTML model: small hand-made pages in which an attribute y="1" or y="0" labels an element and,
until another label, all that is inside it."""

LABELLED = [
    # plain article page with menu, advert and footer
    """<html><head><title>A</title><style>p{}</style></head><body y="0"><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy now, only today.</div><article y="1"><h1>Title of the page</h1><p><b>First words</b> of a longer paragraph, with commas, and some more.</p>
<p>Short.</p><p>A second paragraph follows here. It has two sentences and a <a href="/x">link</a>.</p></article><footer>&copy; Example</footer></body></html>""",
    # main instead of article, aside, form
    """<html><body y="0"><header><h1>Site name</h1><form><input><button>Search</button></form></header><main y="1"><h2>Heading</h2><p>Text of the page,
which runs over some lines, as texts do.</p><ul><li>One point of a list</li><li>Another point</li></ul><blockquote><p>Someone said this.</p></blockquote>
<aside y="0"><p>Related stories</p><ul><li><a href="/r">Story</a></li></ul></aside><p>Last paragraph, after the aside.</p></main>
<aside><h3>Popular</h3><p>Something else to read.</p></aside><footer><p>All rights reserved. Contact us.</p></footer></body></html>""",
    # nested divisions with telling class names
    """<html><body y="0"><div id="header"><div class="menu"><a href="/1">One</a> <a href="/2">Two</a></div></div><div class="cookie-notice"><p>We use cookies to improve this site.</p>
<button>Accept</button></div><div id="content" y="1"><div class="post"><h1>A post</h1><div class="entry-content"><p>What the post says, at some length, so that it is clear.</p>
<h2>Part</h2><p>More of it.</p><table><tr><td>cell</td><td>cell two</td></tr></table><pre>code here</pre></div><div class="share-buttons" y="0"><a href="#">Share</a></div></div></div>
<div id="sidebar"><div class="widget"><h3>Archive</h3><p>By month.</p></div></div><div id="comments" class="comments"><h3>2 comments</h3><div class="comment"><p>I liked this text
very much, thank you for it.</p></div><form><textarea></textarea></form></div><div id="footer">Imprint</div></body></html>""",
    # comments and a newsletter box inside the article
    """<html><body y="0"><header class="site-header"><nav class="breadcrumb"><a href="/">Start</a></nav></header><div class="banner promo"><p>Subscribe and save half.</p></div>
<article class="story" y="1"><header><h1>Long story</h1><p class="lead">The lead of the story tells what it is about.</p></header><p>First the facts, then the rest.</p>
<div class="newsletter" y="0"><p>Get our newsletter each day.</p><form><input></form></div><figure><img><figcaption>A caption of a picture.</figcaption></figure>
<div class="notice" y="0">This page was moved.</div><p>And the end, which is short.</p><section class="comments" y="0"><h2>Comments</h2><p>First, said a reader, and wrote a
whole sentence.</p></section></article><section class="related"><h2>More</h2><a href="/m">More of this</a></section><footer>Terms</footer></body></html>""",
    # an article with sections only
    """<html><body y="0"><nav>Menu</nav><article y="1"><section><h2>One</h2><p>Text of section one, with a <em>stressed</em> word.</p></section><section><h2>Two</h2>
<p>Text of section two.</p><dl><dt>Term</dt><dd>Its meaning.</dd></dl></section><nav class="toc" y="0"><a href="#1">One</a></nav></article><div class="ads">Advert</div>
<div role="complementary" class="side-bar"><p>Elsewhere on this site there is more to see.</p></div></body></html>""",
    # text straight in divisions
    """<html><body y="0"><div class="top-nav"><a href="/a">A</a><a href="/b">B</a></div><div class="article-body" y="1"><h1>Head</h1>Text without a paragraph, then a break<br>
and more of it.<div>A division with text inside it, as old pages have.</div><div class="advertisement" y="0">Sponsored text of some length, with commas, too.</div></div>
<div class="footer-links"><a href="/c">Contact</a></div></body></html>""",
    # no telling container: paragraphs in the body
    """<html><body><h1 y="1">Bare page</h1><p y="1">Some text in a page that has no containers at all, as written by hand.</p><p y="1">Another one.</p>
<ul class="nav" y="0"><li><a href="/">Home</a></li></ul><div class="popup alert" y="0">Alert: sign in.</div><p y="1">Closing words of it.</p></body></html>""",
    # no markup at all; a body with nothing but lines
    """<html y="1">A note without any markup, as some servers send them: a few sentences, one after the other, on a single subject.</html>""",
    """<html y="1"><body y="1">Lines of an old page, straight in its body, with breaks between them and nothing else around them at all.<br>The second line, which says
more on that.<br>And a third one, so that it ends.</body></html>""",
    # asides within an article that advertise; a header and a footer of the site with a paragraph each
    """<html><body y="0"><header class="site-header"><h1>The site</h1><p>All that is new in it, day by day.</p></header><article y="1"><h1>Its story</h1><p>The story begins in a small town by the sea.</p>
<aside class="promotion" y="0"><p>Take part in our draw and win a journey for two.</p></aside><p>It goes on in a large one, far from it.</p><aside class="advert" y="0"><p>New shoes, made to last, at a good price.</p></aside>
<p>And so it ends.</p></article><footer><p>Made by hand, with care, since the year ten.</p></footer></body></html>""",
    # stray words in the body; names that mean nothing by themselves
    """<html><body y="0">Skip to content<nav><a href="/">Home</a></nav><article y="1"><h1>Heading of it</h1><div class="social-history"><p>A paragraph on what people did together in
those times, at some length, with no links in it.</p></div><div class="related-work"><p>Others have written on it before, and they said much the same as this, in more words.</p></div>
<div class="share" y="0"><a href="#">Share</a> <a href="#">Send</a></div><div class="social" y="0"><a href="#">Like us</a></div></article><div class="related"><h3>Related</h3>
<a href="/1">One</a> <a href="/2">Two</a></div><div class="widget"><a href="/t">Tags</a></div></body></html>""",
    # readers' words after the article, in boxes whose names differ from site to site
    """<html><body y="0"><nav><a href="/">Home</a></nav><article y="1"><h1>A walk</h1><p>We went along the river in the morning, and came back by the hill.</p><h2>The hill</h2><p>It is steep, and there is a view.</p></article>
<section class="replies"><h2>Replies</h2><div class="item"><p>We went there too, and the view is fine on clear days.</p></div><div class="item"><p>Take water with you, there is none on the hill.</p></div></section>
<section class="discussion"><h3>Discussion</h3><div class="msg"><p>Is the path open in winter, does anyone know that?</p></div><div class="msg"><p>It is, but bring good shoes.</p></div></section><footer>End</footer></body></html>""",
    """<html><body y="0"><main y="1"><h1>A soup</h1><p>Cut the leeks, and boil them with salt for half an hour.</p><section><h2>To serve</h2><p>Bread goes well with it, and so does cheese.</p></section></main>
<div class="responses"><h3>4 responses</h3><ol><li class="item-x"><p>Made it on Sunday, and all of us liked it.</p></li><li class="item-x"><p>Too much salt for me, but good.</p></li></ol></div>
<section class="reviews"><h2>Reviews by readers</h2><div><p>Five stars, we will make it again next week.</p></div></section><section class="feedback"><h2>Feedback</h2><p>Tell us what you think of it.</p></section>
<div class="thread"><div class="row"><p>Does it keep until the next day?</p></div><div class="row"><p>Yes, in a cool place.</p></div></div></body></html>""",
    # notices inside the article
    """<html><body y="0"><div class="top-bar" y="0">Free delivery this week on all orders.</div><a class="skip-link" href="#m">Skip to content</a><article y="1"><div class="announcement" y="0"><p>Our office is closed on Monday and on Tuesday.</p></div>
<h1>The old mill</h1><p>The mill was built by two brothers, and it ran for a hundred years.</p><div class="paywall" y="0"><p>You have read three free stories. Sign up to go on.</p></div><p>Then the river was moved.</p>
<div class="author-box" y="0"><p>The author lives in the north and writes on mills.</p></div><div class="bio" y="0"><p>She has written two books on rivers and boats.</p></div><div class="legal" y="0"><p>This text is given without any warranty.</p></div></article>
<div class="gdpr"><p>We and our partners store data on your device.</p><a href="/ok">Agree</a></div><div class="pager"><a href="/1">1</a> <a href="/2">2</a></div></body></html>""",
    # a page laid out by a table
    """<html><body y="0"><table><tr><td><a href="/">Home</a> <a href="/n">News</a> <a href="/c">Contact</a></td></tr><tr><td y="1"><h1>A page in a table</h1><p>Old pages were laid out like this, with the text in one cell.</p><p>It went on below.</p></td>
<td><a href="/x">One link</a><br><a href="/y">Another link</a></td></tr><tr><td><a href="/t">Terms</a> | <a href="/p">Privacy</a></td></tr></table></body></html>""",
    # a table and boxes of the article's own; a list of links that belongs to it
    """<html><body y="0"><header><a href="/">Site</a></header><article y="1"><h1>Three rivers</h1><p>There are three rivers in the valley, and they meet below the town.</p><table><tr><th>River</th><th>Length</th></tr><tr><td>First</td><td>20 km</td></tr><tr><td>Second</td><td>35 km</td></tr></table>
<div class="box"><h3>How to get there</h3><p>Take the train, and then walk for an hour.</p></div><div class="para"><p>Each river has a bridge, and one of them has two.</p></div><div class="para"><p>The oldest is of wood.</p></div><ul><li>See the <a href="/m">map</a> of them</li><li>Ask at the inn</li></ul></article></body></html>""",
]

#: Pages that the model is not fitted on, to measure it.
HELD_OUT = [
    """<!doctype html><html><head><title>t</title></head><body y="0"><div id="page"><div id="masthead"><a href="/">Site</a></div><ul class="menu"><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul>
<div id="main" y="1"><h1>On bridges</h1><p>A bridge carries a road over a river, and it has stood here for years.</p><p>It was built of stone.</p><table><tr><th>Year</th><td>1820</td></tr></table></div>
<div class="sidebar"><h4>Latest</h4><ul><li><a href="/l">News of today</a></li></ul></div><div id="footer">All rights reserved.</div></div></body></html>""",
    """<html><body y="0"><header role="banner"><h1>The Paper</h1><nav><a href="/w">World</a></nav></header><main><article class="post" y="1"><h2>Rain in the north</h2><p>Rain fell all night, and the fields are wet.</p>
<aside class="promo" y="0"><p>Read the paper for a month, free of charge.</p></aside><p>Farmers were glad of it, they said on Monday.</p><ul><li>Ten towns</li><li>Two rivers</li></ul></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>We had none here, says a reader in the south.</p></div></section></main><footer><p>About us. Contact.</p></footer></body></html>""",
    """<html><body y="0"><div class="cookie-bar"><p>This site keeps cookies.</p><button>Fine</button></div><div class="wrapper"><div class="post-content" y="1"><h1>Bread</h1><p>Flour, water, salt: that is all it takes.</p>
<blockquote>My mother baked on Fridays.</blockquote><pre>500 g flour</pre><p>Wait a day.</p></div><div class="share-buttons"><a href="#">Post</a><a href="#">Mail</a></div><div class="ads">Ovens, half price this week only.</div></div></body></html>""",
    """<html><body y="1"><h2>Plain page</h2><p>Somebody wrote this by hand and put no boxes around it.</p><p>It has two paragraphs.</p><div class="nav" y="0"><a href="/">Back</a></div></body></html>""",
    """<html><body y="0"><nav class="breadcrumbs"><a href="/">Home</a> &gt; <a href="/g">Garden</a></nav><article y="1"><header><h1>Apples</h1></header><section><h2>Sorts</h2><p>There are red ones and green ones, and some keep all winter.</p></section>
<section><h2>Trees</h2><p>Cut them in March.</p><figure><img src="x"><figcaption>A tree in March.</figcaption></figure></section><footer y="0"><a href="/p">Print</a></footer></article>
<div class="newsletter-signup"><p>Garden letters each week in your post box.</p><form><input><button>Go</button></form></div></body></html>""",
]
